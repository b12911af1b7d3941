"""Near-duplicate embeddings by a pivot-permutation index.

Some vectors serve as pivots. Each vector is described by its nearest pivots in
order of nearness, and listed under each of them. Two vectors are candidates if
enough pivots name both; they are found within the inverted list of a pivot and
counted in the list of the first pivot that they share, so every pair counts
once. Candidates are verified by their cosine in double precision.

Where lists by one pivot would grow long, they are kept by pairs of pivots: the
same candidates, as two that share enough pivots share a pair, in lists whose
length no longer grows with the table until pairs run out.

Equal vectors are one row with a count throughout. A long list is dealt out as
pairs of bounded blocks. Links are not emitted: a unit gives the number of links
of each vector, and a spanning forest of its links for the components.

The pivots come from a sample of bounded size, ``PIVOTS_MOST`` at most, and no
two of them are nearly alike: of a tight group one at most is a pivot, so that
its members agree on it. Every vector is indexed. The tests hold recall against brute force.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing, and each is its own component; only vectors of
equal length are compared; rows that repeat an id and a vector count as vectors
of their own; a row without an id has no links and no component and is kept;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import common, vectors

COSINE = 0.95
#: Pivots at least and at most; nearest pivots that describe a vector; those that candidates share.
PIVOTS_LEAST, PIVOTS_MOST, NEAREST, SHARED = 32, 4096, 8, 2
#: Pivots have smaller cosines than this with each other.
APART = 0.9
#: Mean length of lists by one pivot from which they are kept by pairs.
LONG_LIST = 8192
#: Rows of a block of a list; rows compared at a time.
BLOCK_LEAST, BLOCK, STRIP = 2048, 4096, 512


def pivot_count(rows: int) -> int:
    """A power of two that grows with the root of the rows."""
    return min(PIVOTS_MOST, max(PIVOTS_LEAST, 1 << math.ceil(math.log2(2 * math.sqrt(max(1, rows))))))


def spread(unit: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` rows that are not nearly alike one before them."""
    kept: list[int] = []
    for at in range(len(unit)):
        if len(kept) == count:
            break
        if not kept or (unit[kept] @ unit[at]).max() < APART:
            kept.append(at)
    return unit[kept]


def choose(reps: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, from the rows with the smallest hashes of their ids, as unit vectors."""
    hashed = reps.select("rep", "v", F.xxhash64("rep").alias("h"))
    top = hashed.select("h").orderBy("h").limit(count).agg(F.max("h")).first()[0]
    found: dict[int, list[np.ndarray]] = {}
    if top is not None:
        for _, v in hashed.where(F.col("h") <= top).orderBy("h").limit(count).select("h", "v").collect():
            own = np.array(v, dtype=np.float64)
            found.setdefault(len(own), []).append(own / np.linalg.norm(own))
    return {n: spread(np.stack(rows), count) for n, rows in found.items()}


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The nearest pivots of each row, nearest first; -1 where there are fewer pivots."""
    near = unit @ pivots.T
    k = min(nearest, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
    return np.concatenate([top, np.full((len(top), nearest - k), -1)], axis=1).astype(np.int32)


#: Bits of a pivot in the key of a list; a pair has the smaller pivot, plus one, above them.
PIVOT = (1 << 26) - 1


def _keys(by_pairs: bool) -> Column:
    """Keys of the lists that a vector with these ``names`` stands in."""
    named = F.array_sort(F.filter("names", lambda n: n >= 0)).cast("array<long>")
    if not by_pairs:
        return named
    pairs = F.flatten(F.transform(named, lambda p: F.transform(F.filter(named, lambda q: q > p), lambda q: (p + 1) * (PIVOT + 1) + q)))
    return F.when(F.size(named) > 1, pairs).otherwise(named)


def _unit_links(key: int, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, names: np.ndarray, own: np.ndarray, halves: tuple[int, int], cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links by row of one unit, and edges that connect what its links connect."""
    norm = np.linalg.norm(x, axis=1)
    used = np.unique(names[names >= 0])
    sign = np.zeros((len(ids), len(used)), dtype=np.float32)
    rows, places = np.nonzero(names >= 0)
    sign[rows, np.searchsorted(used, names[rows, places])] = 1
    # The unit counts pairs whose first shared pivots are those of its key, so every pair counts once.
    before = sign[:, used < (key & PIVOT)]
    above = int(key > PIVOT)
    need = min(shared, len(used))
    left, right = (np.flatnonzero(own == h) for h in halves)
    same = halves[0] == halves[1]
    count = np.zeros(len(ids), dtype=np.int64)
    for at in range(0, len(left), STRIP):
        a = left[at : at + STRIP]
        candidate = (sign[a] @ sign[right].T >= need) & (before[a] @ before[right].T == above)
        if same:
            candidate &= np.arange(at, at + len(a))[:, None] < np.arange(len(right))[None, :]
        hit = candidate.any(axis=1)
        a, candidate = a[hit], candidate[hit]
        some = np.flatnonzero(candidate.any(axis=0))
        b = right[some]
        link = candidate[:, some] & ((x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine)
        count[a] += link @ sizes[b]
        count[b] += sizes[a] @ link
    linked = np.flatnonzero(count)
    y, z = x[linked], norm[linked]
    i, j = common.forest(len(linked), lambda p, q: (y[p] @ y[q].T) / (z[p][:, None] * z[q][None, :]) >= cosine)
    return count, linked[i], linked[j]


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per input row: id, n_links, component_id and kept."""
    spark = rows.sparkSession
    common.scratch(spark)
    good = vectors.clean(rows, id_col, vector_col)
    width = "array<float>" if "float" in dict(good.dtypes)["v"] else "array<double>"
    reps = common.cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "vectors")
    count = reps.count()
    pivots = choose(reps, pivot_count(count))
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))

    @common.tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors.lists(batch.column("v"))
            names = np.full((len(own), nearest), -1, dtype=np.int32)
            for n in {len(v) for v in own}:
                at = [k for k, v in enumerate(own) if len(v) == n]
                if n in pivots:
                    x = np.stack([own[k] for k in at])
                    near = nearest_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), pivots[n], nearest)
                    names[at] = np.where(near >= 0, near + first[n], -1)
                else:  # a length that the sample lacks has one list of its own
                    names[at, 0] = (1 << 24) + n
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("size"), batch.column("v"), pa.array(list(names), pa.list_(pa.int32()))], ["rep", "size", "v", "names"])

    described = reps.select("rep", "size", "v").mapInArrow(describe, f"rep long, size long, v {width}, names array<int>")
    total = sum(map(len, pivots.values()))
    by_pairs = shared > 1 and total >= 4 * nearest and count * nearest > LONG_LIST * total
    listed = described.withColumn("pivot", F.explode(_keys(by_pairs)))
    units = common.pair_blocks(listed, "pivot", "rep", least=BLOCK_LEAST, most=BLOCK)

    @common.tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, ["pivot", "bi", "bj"], BLOCK):
            a, b, n = [], [], []
            for at, end in zip(starts, [*starts[1:], len(table)]):
                unit = table.slice(at, end - at)
                ids, sizes = unit.column("rep").to_numpy(), unit.column("size").to_numpy()
                count, i, j = _unit_links(unit.column("pivot")[0].as_py(), ids, sizes, vectors.matrix(unit.column("v")), np.stack(unit.column("names").to_pylist()), unit.column("_own").to_numpy(), (unit.column("bi")[0].as_py(), unit.column("bj")[0].as_py()), cosine, shared)
                some = np.flatnonzero(count)
                a += [ids[some], ids[i]]
                b += [ids[some], ids[j]]
                n += [count[some], np.zeros(len(i), dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, n)], ["a", "b", "n"])

    found = common.cut(units.select("pivot", "bi", "bj", "_own", "rep", "size", "v", "names").mapInArrow(compare, "a long, b long, n long"), "links")
    joined = common.components(found.select("a", "b"), "vector-links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "_a")
    told = reps.join(links, F.col("rep") == F.col("_a"), "left").join(joined, F.col("rep") == F.col("id"), "left")
    told = told.select(F.col("v").alias("_v"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(width).alias("v"))
    every = every.withColumn("v", F.when(F.col("id").isNotNull() & vectors.usable("v"), F.col("v")))
    out = every.join(told, F.col("v") == F.col("_v"), "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
