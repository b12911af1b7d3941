"""Registered queries without SQL, against plain Python over whole tables."""

import hashlib
import os
import re
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketry.functions import extract
from docketry.operators import chunks, glossary
from docketry.plans import catalogue
from docketry.sources.tables import cases

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_rouge_l(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    words = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in catalogue.queries()["rouge_l"](spark, FOLDER).collect()}
    assert sorted(got) == sorted(set(docs) & set(items))
    for k, found in got.items():
        a, b = words(docs[k]), words(items[k])
        hit = longest_common(a, b)
        p, r = hit / len(a), hit / len(b)
        assert found == pytest.approx((p, r, 2 * p * r / (p + r) if hit else 0), abs=1e-6)


def test_glossary_fuzzy(spark):
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect())
    term = lambda t: " ".join(t.split(" ")[:3])
    typed = [(k, (w := term(t))[:3] + w[4:] + w[-1:]) for k, t in items]
    told = spark.createDataFrame([(None, q) for _, q in typed] + [(None, term(t)) for _, t in items], "x int, q string").select("q", glossary.normal(F.col("q")).alias("n"))
    plain = {r.q: r.n for r in told.distinct().collect()}
    entries = [(term(t), plain[term(t)], k % 6, 99.0) for k, t in items] + [(term(t), f"item {k}", k % 6, 100.0) for k, t in items]
    entries += [(t, n.lower(), i, 99.0 if n == t else 100.0) for t, names, _, i in glossary.SEED for n in [t, *names]]
    want = {}
    for k, q in ((k, plain[q]) for k, q in typed):
        scores = {}
        for name, low, importance, exact in entries:
            extra = (importance - 3) * 2.0
            ratio = SequenceMatcher(a=q, b=low).ratio()
            own = [exact + 1000] if q == low else [82.0 + extra] * (q in low or low in q) + [70.0 + ratio * 20.0 + extra] * (ratio >= 0.72)
            if own:
                scores[name] = max([scores.get(name, 0), *own])
        assert max(scores.values()) < 1000  # no question is a name as it stands
        for place, (score, name) in enumerate(sorted((-s, n) for n, s in scores.items())[:5]):
            want[k, place + 1] = (name, round(-score, 9))
    got = {(r.query_id, r["rank"]): (r.term, round(r.score, 9)) for r in catalogue.queries()["glossary_fuzzy"](spark, FOLDER).collect()}
    assert got == want


def tokens_of(t):
    return max(1, len(t) // 4) if t else 0


def split(t):
    for full, mark in ((r"\bG\.R\.\s+No\.", "\1"), (r"\bA\.M\.\s+No\.", "\2"), (r"\bU\.S\.", "\3"), (r"\bPhil\.", "\4")):
        t = re.sub(full, lambda _, m=mark: m, t)
    parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])", t)
    whole = {"\1": "G.R. No.", "\2": "A.M. No.", "\3": "U.S.", "\4": "Phil."}
    parts = [re.sub("[\1-\4]", lambda m: whole[m.group()], p).strip(" \t\n\x0b\f\r") for p in parts]
    return [p for p in parts if len(p) >= 11]


def filled(parts, size=640, overlap=96):
    """One sentence after the other, as the rule is told."""
    done, now = [], []
    for s in parts:
        if now and sum(map(tokens_of, now)) + tokens_of(s) > size:
            done.append(now)
            kept = []
            while len(kept) < len(now) and sum(map(tokens_of, kept)) + tokens_of(now[-len(kept) - 1]) <= overlap:
                kept = now[-len(kept) - 1 :]
            now = kept
        now = [*now, s]
    return done + ([now] if now else [])


def test_section_chunks(spark):
    kinds = {"ruling": "dispositive", "facts": "factual", "issues": "issues", "arguments": "legal_analysis"}
    found = cases(spark, FOLDER).select("doc_id", "gr_number", "special_number", extract.sections(F.col("clean_text"), extract.DISPOSITIVE).alias("s")).collect()
    want, long_ones = {}, 0
    for r in found:
        case, made = r.gr_number or r.special_number or str(r.doc_id), []
        for s in r.s:
            content, name = s.content.strip(), "ruling" if s.section == "dispositive" else s.section
            short = s.section in ("ruling", "dispositive", "issues") and tokens_of(content) <= 1200
            pieces = [] if not content else [content] if short else [" ".join(w) for w in filled(split(content))]
            long_ones += not short and len(pieces) > 1
            made += [(name, n, t) for n, t in enumerate(t for t in pieces if short or tokens_of(t) >= 200)]
        for k, (name, n, t) in enumerate(made):
            key = str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{case}_{name}_{n}"))
            want[r.doc_id, k + 1] = (key, name, kinds.get(name, "general"), n, tokens_of(t), hashlib.md5(t.encode()).hexdigest(), len(made) + 1)
    rows = catalogue.queries()["section_chunks"](spark, FOLDER).collect()
    got = {(r.doc_id, r.chunk_index): (r.id, r.section, r.section_type, r.paragraph_index, r.token_count, r.digest, r.total_chunks) for r in rows if r.chunk_index}
    assert got == want and long_ones
    assert sorted(r.doc_id for r in rows if not r.chunk_index) == sorted(r.doc_id for r in found)


def test_spans_by_search():
    import random

    draw = random.Random(5)
    for _ in range(400):
        tokens = [draw.choice([0, 1, 3, 20, 90, 97, 300, 640, 641, 900]) for _ in range(draw.randrange(40))]
        texts = ["x" * (4 * n) for n in tokens]
        assert [b - a + 1 for a, b in chunks.spans_of(tokens)] == [len(w) for w in filled(texts)]
    assert chunks.spans_of([]) == []
    assert len(chunks.spans_of([1] * 2_000_000)) == 1 + -(-(2_000_000 - 640) // 544)


def test_windows_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["a" * 800]), (4, ["b" * 100])], "k int, parts array<string>")
    got = {r.k: r.w for r in df.select("k", chunks.windows(F.col("parts")).alias("w")).collect()}
    assert got == {1: None, 2: [], 3: ["a" * 800], 4: []}


def test_title_case(spark):
    """Every caption keeps its letters and begins with a capital; a check of bounds, not a plain version of the rules."""
    rows = cases(spark, FOLDER).select("doc_id", "case_title").collect()
    got = {r.doc_id: r.title for r in catalogue.queries()["title_case"](spark, FOLDER).collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    for r in rows:
        assert got[r.doc_id].lower() == r.case_title.lower() and got[r.doc_id][0].isupper()


def test_sections_that_records_bring(spark):
    rows = [(1, None), (2, {}), (3, {"Facts": " ", "Issues": None}), (4, {"DISPOSITIVE": " So ordered. ", "Facts": None}), (5, {"Annex": "x" * 900})]
    df = spark.createDataFrame([(k, "A text of its own. " * 60, None, None, s) for k, s in rows], "id int, clean_text string, gr_number string, special_number string, sections map<string,string>")
    got = {}
    for r in chunks.case_chunks(df).where("chunk_type <> 'summary'").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.section, r.section_type, r.content[:11], r.chunk_id))
    assert [got[k][0][:3] for k in (1, 2, 3)] == [("body", "general", "A text of i")] * 3
    assert got[4] == [("ruling", "dispositive", "So ordered.", str(uuid.uuid5(uuid.NAMESPACE_DNS, "4_ruling_0")))]
    assert [x[:3] for x in got[5]] == [("annex", "general", "x" * 11)]
