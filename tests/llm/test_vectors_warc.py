"""Vector operators against brute force, archives by round trip."""

import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from docketry.llm import common, lshforest, pivots, warc


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), v if v is None else [float(a) for a in v], 5, 6) for k, v in zip(ids, x)], "vec_id long, embedding array<float>, n_links int, v int")


def cosines(x):
    u = np.asarray(x, dtype=np.float32).astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def clusters(seed, n=600, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n, 3):  # near copies at all distances around the bound
        x[k + 1] = x[k] + rng.standard_normal(dim) * rng.uniform(0.02, 0.5)
    x[-40:] = x[0] + rng.standard_normal((40, dim)) * 0.05
    x[100:110] = x[99]
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed):
    x = clusters(seed)
    s = cosines(x)
    link = (s >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in pivots.near_duplicates(table(spark, x)).collect()}
    found, real = sum(r.n_links for r in got.values()), int(link.sum())
    assert 0.97 * real <= found <= real
    at = list(range(len(x)))
    for a, b in zip(*np.nonzero(link)):
        a, b = int(a), int(b)
        while at[a] != a:
            a = at[a]
        while at[b] != b:
            b = at[b]
        at[max(a, b)] = min(a, b)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    same = np.mean([got[k].component_id == root(k) for k in range(len(x))])
    assert same > 0.98 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_do_not_change_links(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal(24) + np.random.default_rng(6).standard_normal((300, 24)) * 0.12
    whole = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table(spark, x)).collect()}
    monkeypatch.setattr(pivots, "BLOCK_LEAST", 32)
    monkeypatch.setattr(pivots, "BLOCK", 32)
    assert {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table(spark, x)).collect()} == whole
    s = (cosines(x) >= 0.95).sum(axis=1) - 1
    assert sum(n for n, _ in whole.values()) >= 0.97 * s.sum()


def test_lists_by_pairs_give_the_same_links(spark, monkeypatch):
    x = clusters(7)
    single = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table(spark, x)).collect()}
    monkeypatch.setattr(pivots, "LONG_LIST", 1)
    assert {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table(spark, x)).collect()} == single


ODD = [[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [1, 0, 0], [2, 0], [0, 1], []]


def test_vectors_that_take_no_part(spark):
    df = table(spark, ODD).union(spark.createDataFrame([(None, [1.0, 0.0], 1, 1)], "vec_id long, embedding array<float>, n_links int, v int"))
    hole = spark.createDataFrame([(20, [None, 1.0], 1, 1)], "vec_id long, embedding array<float>, n_links int, v int")
    df = df.union(hole)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[7] == (2, 0, False)
    for k in (2, 3, 4, 5, 6, 8, 9, 20):
        assert got[k] == (0, k, True)
    assert got[None] == (0, None, True)
    assert pivots.near_duplicates(df.where("false")).count() == 0
    near = lshforest.search(df, df.where("vec_id in (0, 2, 3)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(near, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 7), (0, 3, 8)]
    assert lshforest.search(df.where("false"), df.where("false")).count() == 0


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 64))
    x = centres[rng.integers(0, 10, 6000)] * 0.9 + rng.standard_normal((6000, 64))
    df = table(spark, x)
    got = {}
    for r in lshforest.search(df, df.where(lshforest.every("vec_id", 50))).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    s = cosines(x)
    hit = 0
    for q in range(0, 6000, 50):
        order = [k for k in np.lexsort((np.arange(6000), -s[q])) if k != q][:5]
        hit += len({v for v, _ in got[q].values()} & set(order))
        ranked = [got[q][k] for k in range(1, 6)]
        assert ranked == sorted(ranked, key=lambda p: (-p[1], p[0]))
        assert all(score == pytest.approx(s[q, v], abs=1e-12) for v, score in ranked)
    assert hit / (120 * 5) >= 0.9


def _recall(x, forest, queries, miss):
    s = cosines(x)
    hit = share = 0
    for q, (ids, score, verified) in zip(queries, forest.nearest(queries, x[queries], 5, miss)):
        order = [k for k in np.lexsort((np.arange(len(x)), -s[q])) if k != q][:5]
        hit += len(set(ids.tolist()) & set(order))
        share += verified / len(x)
    return hit / (5 * len(queries)), share / len(queries)


def test_share_of_rows_that_is_verified():
    rng = np.random.default_rng(2)
    tight = rng.standard_normal((600, 64))[rng.integers(0, 600, 8000)] + rng.standard_normal((8000, 64)) * 0.25
    loose = rng.standard_normal((8000, 64))
    queries = np.arange(0, 8000, 100)
    for x, most in ((tight, 0.02), (loose, 0.45)):
        x = x.astype(np.float32).astype(np.float64)
        forest = lshforest.Forest(np.arange(8000), x)
        recall, share = _recall(x, forest, queries, lshforest.MISS)
        assert recall >= 0.9 and share <= most
    # Without a chance of missing anything all rows are seen, and the result is exact.
    assert _recall(x, forest, queries[:20], 0.0) == (1.0, pytest.approx(7999 / 8000))


def test_twice_the_rows_in_groups_need_no_more_candidates():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((1600, 64))
    shares = []
    for n in (4000, 8000, 16000):
        x = centres[np.arange(n) % (n // 10)] + rng.standard_normal((n, 64)) * 0.2
        queries = np.arange(0, n, n // 40)
        recall, share = _recall(x, lshforest.Forest(np.arange(n), x), queries, lshforest.MISS)
        assert recall >= 0.9
        shares.append(share)
    assert shares[2] < 0.6 * shares[0]


def test_ties_go_to_smaller_ids(spark):
    x = np.tile(np.random.default_rng(3).standard_normal(16), (40, 1))
    df = table(spark, x)
    got = lshforest.search(df, df.where("vec_id = 7")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def pages(spark):
    body = "<html>" + "long enough payload " * 10 + "é</html>"
    rows = [(5, "http://a", body), (3, None, body), (9, "http://b\r\nX: y", body), (4, "http://c", "short"), (6, "http://d", "short"), (7, "http://e", None), (None, "http://f", body), (3, None, body), (8, "http://g", "x" * 300000)]
    return spark.createDataFrame([(*r, "clash", "k") for r in rows], "page_id long, url string, html string, digest string, first string"), body


def test_round_trip(spark):
    df, body = pages(spark)
    files = warc.write(df, common.fresh(spark, "warc-test"), file_bytes=2000)
    got = sorted(warc.read(files).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "response", None), (3, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 3)]
    for r in got:
        if r.page_id in (3, 5, 9):
            assert (r.payload_digest, r.payload_bytes) == (digest, len(body.encode()))
    assert next(r for r in got if r.page_id == 8).payload == "x" * 300000
    heads = [h for f in files.collect() for h, _ in warc.records(f.path)]
    own = [h["warc-record-id"] for h in heads]
    assert len(set(own)) == len(own) == 9
    # Page 3 occurs twice, so its revisits name the page; every record that is named exists.
    assert all(h["x-refers-to-page-id"] == "3" and "warc-refers-to" not in h for h in heads if h["warc-type"] == "revisit")
    assert all(r.page_id is not None and r.record_type == "revisit" for r in got if r.refers_to is not None)
    assert warc.read(warc.write(df.where("false"), common.fresh(spark, "warc-test"))).count() == 0


def test_revisits_name_a_record(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)
    df = spark.createDataFrame([(k, None, ("a" if k % 3 else "b") * 150) for k in range(30)], "page_id long, url string, html string")
    files = warc.write(df, common.fresh(spark, "warc-test"))
    heads = [h for f in files.collect() for h, _ in warc.records(f.path)]
    whole = {h["warc-record-id"]: h["x-page-id"] for h in heads if h["warc-type"] == "response"}
    assert sorted(whole.values()) == ["0", "1"] and len({h["warc-record-id"] for h in heads}) == 30
    for h in heads:
        if h["warc-type"] == "revisit":
            assert whole[h["warc-refers-to"]] == h["x-refers-to-page-id"] == ("1" if int(h["x-page-id"]) % 3 else "0")


def test_pages_without_anything(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, None), (1, None, None)], "page_id long, url string, html string")
    got = warc.read(warc.write(df, common.fresh(spark, "warc-test"))).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got) == [(0, 0, "response"), (0, 0, "response"), (1, 0, "response")]


def test_dictionary_holds_headers_of_records(spark):
    df = spark.createDataFrame([(k, f"http://site.example/page/{k}", f"<html>page {k} of a site with words {k * 7919 % 1000}</html>" * 4) for k in range(400)], "page_id long, url string, html string")
    assert b"WARC-Target-URI: http://site.example/page/" in warc.train(df)


def test_format(tmp_path):
    samples = [warc.http_head(50) + f"<html><p>page {k} with words that repeat</p></html>".encode() * 3 for k in range(200)]
    known = zstandard.train_dictionary(2000, samples).as_bytes()
    path = str(tmp_path / "a.warc.zst")
    out = warc.Writer(path, known)
    for k in range(20):
        out.add(warc.record("response", k, "http://x", samples[k], "0", None), 1)
    out.close()
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8 : 8 + size] == known
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)).decompressobj()
    assert first.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\n") and first.unused_data  # a frame for each record
    assert [int(h["x-page-id"]) for h, _ in warc.records(path)] == list(range(20))
    open(path, "wb").write(raw[:-5])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records(path))
