"""The pipeline against plain versions of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from plain import dedup_lines, simhash_groups, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from docketry.llm import ordinal

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdefgé") for _ in range(pick.randint(2, 8)))
    passage = " ".join(word() for _ in range(80))
    out = []
    for _ in range(60):
        out.append("\n".join(" ".join(word() for _ in range(pick.randint(5, 40))) for _ in range(pick.randint(1, 5))))
    for k in range(0, 12, 2):
        words = out[k].split(" ")
        words[len(words) // 2] = "edited"
        out.append(" ".join(words))  # near copies
        out.append(out[k])  # exact copies
    out += [out[20] + "\nown " + passage + " end one", out[21][:30] + " then " + passage + " finis"]
    out += [(out[k] + " rude" + word()).upper() for k in range(30, 40)]
    return [*out, None, "", "\n"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    data = texts()
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(data)], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(not (t or "x").isupper()), 0) for k, t in enumerate(data)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id: r.text for r in ordinal.classify(docs, labels).where("kept").collect()}
    lines = dedup_lines(list(kept.items()))
    rest = {}
    for k, own in lines.items():
        text = kept[k] if kept[k] is None else "\n".join(own)
        touched = text != kept[k]
        if not touched or text.split():
            rest[k] = text
    groups = simhash_groups(list(rest.items()))
    rest = {k: t for k, t in rest.items() if groups[k] == k}
    names = sorted(rest)
    final = {}
    for k, (left, removed, _) in zip(names, without_repeats([rest[k] for k in names])):
        if not removed or left:
            final[k] = left.decode(errors="ignore")
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = spark.createDataFrame(stage(spark, got, folder).collect(), docs.schema)
        assert got.columns == docs.columns, name
    assert {r.doc_id: r.text or "" for r in got.collect()} == final
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        ids = np.array([*coder.encode(final[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
    assert set(pieces) == set(final)


def test_stages_on_odd_tables(spark, folder):
    none = spark.createDataFrame([], COLUMNS)
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "x", "y", 0)], COLUMNS)
    clash = odd.selectExpr("*", "1 AS kept", "2 AS n_removed", "3 AS id", "'s' AS spans")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
        assert stage(spark, odd, folder).count() >= 1
        assert stage(spark, clash, folder).count() >= 1
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, folder).columns == clash.columns


def test_last_stage_takes_long_runs(spark, tmp_path):
    from tokenizers import Tokenizer

    from docketry.llm import registry

    texts = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "a" * 1_000_000, None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).collect()
    library = Tokenizer.from_file(registry.TOKENIZER)
    for k, text in enumerate(texts):
        assert sum(r.length for r in pieces if r.doc_id == k) == len(library.encode(text or "", add_special_tokens=False).ids) + 1
