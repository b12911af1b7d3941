"""The registered queries on the smallest tables, against plain versions, SQL or the library."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from plain import dedup_lines, fingerprint, simhash_groups, without_repeats
from test_lm_quality import plain_scores
from tokenizers import Tokenizer

from docketry.llm import lm, registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def rows(spark, name):
    return registry.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    sql = duckdb.connect()
    for table in ("embeddings", "pages", "conversations", "documents", "benchmark"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    expected = sorted((tuple(r) for r in found.fetchall()), key=repr)
    got = registry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names) and sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == expected


def test_op2(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op2_quality")}
    assert sorted(got) == [k for k, _ in texts]
    for r in got.values():
        assert 0 <= r.tail_probability <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.65)


def test_op3(spark, texts):
    groups = simhash_groups(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op3_simhash")} == {k: (f"{fingerprint(t):016x}", groups[k]) for k, t in texts}


def test_op4(spark, texts):
    held = lambda k: zlib.crc32(str(texts[k][0]).encode()) % 7 == 2
    got = {r.doc_id: r for r in rows(spark, "op4_lm")}
    for k, (n, known, train, base, score) in enumerate(plain_scores([t for _, t in texts], held, lm.ORDER)):
        r = got[texts[k][0]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_op5(spark, texts):
    expected = dedup_lines(texts)
    for r in rows(spark, "op5_line_dedup"):
        text = dict(texts)[r.doc_id]
        kept = "\n".join(expected[r.doc_id])
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert (r.n_lines, r.n_lines - r.n_removed) == (text.count("\n") + 1, len(expected[r.doc_id]))


def test_op6(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    ids, x = np.array([k for k, _ in table]), np.array([v for _, v in table], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(rows(spark, "op6_ann"), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == sorted(k for k in ids.tolist() if k % 50 == 0)
    hit = 0
    for q, found in got.items():
        score = u @ u[ids == q][0]
        order = [k for k in ids[np.lexsort((ids, -score))].tolist() if k != q][:5]
        assert len(found) == 5
        hit += len(set(order) & set(found))
    assert hit >= 0.9 * 5 * len(got)


def test_op7_and_op9(spark, texts):
    library = Tokenizer.from_file(registry.TOKENIZER)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts}
    for r in rows(spark, "op9_bpe"):
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op7_packing"):
        own = [*ids[r.doc_id], 0]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for whole, size in [*((pieces[k], len(ids[k]) + 1) for k in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(whole):
            assert start == at and length > 0
            at += length
        assert at == size if size else at <= 1024


def test_op8(spark, texts):
    expected = dict(zip((k for k, _ in texts), without_repeats([t for _, t in texts])))
    for r in rows(spark, "op8_suffix_array"):
        kept, removed, runs = expected[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (removed, runs, hashlib.sha256(kept).hexdigest())
