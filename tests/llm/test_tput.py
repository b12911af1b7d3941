"""Top-k lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docketry.llm import common, tput

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """Results by scoring every document for every question."""
    held = [(name, Counter(ws), len(ws)) for name, ws in ((n, words(t)) for n, t in docs) if ws]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scores = []
        for name, tf, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
            if score > 0:
                scores.append((-score, math.inf if name is None else name))
        out += [(item, place + 1, None if name == math.inf else name, -score) for place, (score, name) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **more):
    d = spark.createDataFrame([(n, t, "clash", 5, 6) for n, t in docs], "doc_id long, text string, term string, score long, rank int")
    q = spark.createDataFrame([(n, t, "clash", 7) for n, t in items], "item_id long, text string, doc_id string, question long")
    got = tput.search(d.repartition(3), q.repartition(2), k, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(pick, sizes, vocabulary):
    text = lambda: " ".join(pick.choice(vocabulary[: pick.choice([4, 40, 400])]) for _ in range(pick.choice(sizes)))
    return text


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equal_to_scores_of_all_pairs(spark, k):
    pick = random.Random(k)
    vocabulary = ["the", "Of", "été", "x" * 90, "x" * 89 + "y", "longerthaneight", "longerthanninee", *(f"w{n}" for n in range(393))]
    text = made(pick, [0, 1, 3, 20, 200], vocabulary)
    docs = [(n, text()) for n in range(300)]
    docs += [(n, docs[7][1]) for n in range(300, 420)]  # a large group of copies: ties
    items = [(n, text()) for n in range(12)] + [(99, docs[7][1])]
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_blocks_of_questions(spark):
    pick = random.Random(9)
    text = made(pick, [3, 20], [f"w{n}" for n in range(400)])
    docs, items = [(n, text()) for n in range(60)], [(n, text()) for n in range(20)]
    assert found(spark, docs, items, 4, block=30) == plain(docs, items, 4)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "... _ -- \t\n"), (4, "alpha beta"), (4, "alpha beta"), (4, "beta"), (None, "alpha gamma"), (6, "a,b;c\x00d `e`[f]{g}~h"), (7, "alpha " * 200_000 + "omega"), (8, "ALPHA İ ß"), (9, "other")]
    items = [(1, "Alpha?"), (1, "Alpha?"), (2, None), (3, "!!"), (None, "a b c d e f g h"), (5, "nowhere"), (6, "OMEGA beta beta"), (7, "i̇ İ ẞ ß")]
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 3) == [] == found(spark, [(1, "a")], [], 3) == found(spark, [(1, "...")], [(1, "a")], 3)


def test_terms_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(common, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    terms = [b"one", b"two", b"x" * 70]
    data = np.frombuffer(b"two one six " + b"x" * 70, np.uint8)
    start, end = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 82])
    assert tput.Vocabulary(terms).find(data, start, end).tolist() == [1, 0, -1, 2]


def test_lists_are_not_fetched_whole(spark, monkeypatch):
    """Common words fall below the threshold: their entries are looked up for candidates alone."""
    pick = random.Random(3)
    docs = [(n, " ".join(["the", "of", *(f"r{pick.randint(0, 200)}" for _ in range(6))])) for n in range(2000)]
    items = [(1, "the of r1 r2 r3")]
    sizes = {}
    real = common.cut

    def cut(df, what):
        out = real(df, what)
        sizes[what] = out.selectExpr("sum(size(terms))").first()[0] if what == "fetched" else out.count()
        return out

    monkeypatch.setattr(common, "cut", cut)
    assert found(spark, docs, items, 3) == plain(docs, items, 3)
    assert sizes["fetched"] < sizes["lists"] / 5 and sizes["candidates"] < 300
