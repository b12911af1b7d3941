"""SimHash groups against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docketry.llm import common, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, links):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_groups(spark):
    pick = random.Random(1)
    base = [" ".join(pick.choice("alpha beta gamma delta eps Zeta été".split()) + str(pick.randint(0, 30)) for _ in range(120)) for _ in range(40)]
    texts = []
    for t in base:
        words = t.split()
        texts.append(t)
        for _ in range(3):
            other = list(words)
            other[pick.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    texts += [None, "", " \n", "one", "one two", "ONE two", texts[0], texts[0], "word " * 5000]
    rows = [(k, t, 7, 8) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id long")).collect()}
    fps = {k: plain(t) for k, t in enumerate(texts)}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {k: r.component_id for k, r in got.items()} == groups(list(fps), links)


def test_links_of_random_fingerprints(spark):
    pick = random.Random(2)
    fps = set()
    for _ in range(60):
        f = pick.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            g = f
            for b in pick.sample(range(64), pick.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    hub = pick.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}  # one large group
    fps = sorted(fps)
    df = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(fps)], "rep long, fp long")
    found = {r.id: r.component_id for r in common.components(simhash.link(df)).collect()}
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    expected = groups(range(len(fps)), links)
    assert {k: found.get(k, k) for k in expected} == expected


def test_null_ids_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (9, "other words stand here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (3, 3), (3, 3), (5, 3), (9, 9)]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(df).collect()) == [0, 3, 3, 9]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(edges).collect()
    assert len(got) == 301 and {r.component_id for r in got} == {0}
    assert common.components(edges.where("false")).count() == 0


def test_large_groups_meet_in_blocks(spark):
    df = spark.range(700).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("uid"))
    units = common.pair_blocks(df, "key", "uid", least=64).toPandas()
    met = set()
    for _, unit in units.groupby(["key", "bi", "bj"]):
        assert len(unit) <= 2 * 110
        ids = unit.uid.tolist()
        met |= {(a, b) for a in ids for b in ids if a < b}
    assert len(met) == 700 * 699 // 2
