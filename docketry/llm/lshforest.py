"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of hash strings, one bit for each of its random
hyperplanes. A query descends each tree to the entries that share its longest
prefix. Then all trees are ascended together, one bit at a time: the entries
that share the shorter prefix join the candidates, whose cosines are computed
in double precision at once.

The ascent ends by itself: a row at cosine s shares a bit with the query with
probability p = 1 - acos(s) / pi, so it is in none of T ranges of prefixes of n
bits with probability (1 - p**n)**T. Once that is at most ``MISS`` for the
score of the last neighbour found, a nearer row is unlikely to be missing. So
queries in tight groups end after few rows, and those whose neighbours are
hardly nearer than chance see a large part of the rows. With ``miss`` 0 each
query ascends to the roots, and the result is exact.

Rows are dealt into blocks of bounded size, each with a forest of its own, and
queries into blocks as well; each block of queries searches each block of rows,
and the best of all blocks are merged. Equal vectors have equal strings in all
trees, so they are candidates together. The tests hold recall and the share of
rows that is verified against brute force.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without an id; only vectors of equal
length are compared; a query's own id is no candidate of it; rows that repeat
an id are one query and one candidate each, their best score counting; ties go
to the smaller id; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import common, vectors

TOP = 5
#: Trees; bits of a string; probability of missing a row as near as the last neighbour at which the ascent ends.
TREES, DEPTH, MISS = 192, 24, 0.1
#: Rows and queries of a block; queries whose ranges are held at a time.
ROWS, QUERIES, AT_ONCE = 16384, 32768, 2048
SEED = 7


class Forest:
    """Sorted arrays of hash strings over the rows of a matrix, with ids that ascend."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.ids, self.x, self.norm = ids, x, np.linalg.norm(x, axis=1)
        self.trees, self.depth = trees, depth
        self.many = bool((ids[1:] == ids[:-1]).any())
        planes = np.random.default_rng(seed).standard_normal((trees, depth, x.shape[1]))
        self.planes = planes / np.linalg.norm(planes, axis=2, keepdims=True)
        self.order, self.strings = np.empty((trees, len(x)), dtype=np.int32), np.empty((trees, len(x)), dtype=np.int32)
        for t in range(trees):
            own = self.hash(x, t)
            self.order[t] = np.argsort(own, kind="stable")
            self.strings[t] = own[self.order[t]]

    def hash(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The strings of rows in one tree, first bit highest."""
        bits = x @ self.planes[tree].T > 0
        return (bits.astype(np.int64) @ (1 << np.arange(self.depth - 1, -1, -1, dtype=np.int64))).astype(np.int32)

    def _met(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of a range in each tree, as often as they are met."""
        size = high - low
        first = np.arange(self.trees) * self.order.shape[1] + low
        return self.order.ravel()[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def _best(self, rows: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best ``top`` of distinct ids."""
        if self.many and len(rows):
            by = np.lexsort((-score, self.ids[rows]))
            rows, score = rows[by], score[by]
            first = np.concatenate([[True], self.ids[rows[1:]] != self.ids[rows[:-1]]])
            rows, score = rows[first], score[first]
        by = np.lexsort((self.ids[rows], -score))[:top]
        return rows[by], score[by]

    def nearest(self, names: np.ndarray, y: np.ndarray, top: int = TOP, miss: float = MISS):
        """(ids, scores, rows verified) of each query, by name and vector."""
        for at in range(0, len(y), AT_ONCE):
            yield from self._nearest(names[at : at + AT_ONCE], y[at : at + AT_ONCE], top, miss)

    def _nearest(self, names: np.ndarray, y: np.ndarray, top: int, miss: float):
        n, size = len(self.ids), np.linalg.norm(y, axis=1)
        strings = np.stack([self.hash(y, t) for t in range(self.trees)])
        low, high = np.zeros(strings.shape, dtype=np.int64), np.zeros(strings.shape, dtype=np.int64)
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(y)
        seen: dict[int, np.ndarray] = {}
        verified = np.zeros(len(y), dtype=np.int64)
        open_ = np.arange(len(y))
        for up in range(self.depth + 1):
            for t in range(self.trees):
                base = strings[t, open_] >> up << up
                low[t, open_] = np.searchsorted(self.strings[t], base)
                high[t, open_] = np.searchsorted(self.strings[t], base + (1 << up))
            stay = []
            for q in open_.tolist():
                own = seen.setdefault(q, np.zeros(n, dtype=bool))
                met = self._met(low[:, q], high[:, q]) if up < self.depth else np.arange(n)
                met = np.unique(met[~own[met]])
                own[met] = True
                met = met[self.ids[met] != names[q]]
                verified[q] += len(met)
                rows, score = best[q]
                if len(met):
                    rows, score = best[q] = self._best(np.concatenate([rows, met]), np.concatenate([score, (self.x[met] @ y[q]) / (self.norm[met] * size[q])]), top)
                agree = 1 - math.acos(max(-1.0, min(1.0, score[-1]))) / math.pi if len(rows) == top else 0.0
                if up < self.depth and (1 - agree ** (self.depth - up)) ** self.trees > miss or len(rows) < top and up < self.depth:
                    stay.append(q)
                else:
                    del seen[q]
            open_ = np.array(stay, dtype=np.int64)
            if not stay:
                break
        for (rows, score), count in zip(best, verified.tolist()):
            yield self.ids[rows], score, count


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for every query, nearest first."""
    spark = rows.sparkSession
    common.scratch(spark)
    data = common.cut(vectors.clean(rows, id_col, vector_col), "forest-rows")
    asked = common.cut(vectors.clean(queries, id_col, vector_col), "forest-queries")
    blocks = max(1, -(-data.count() // ROWS))
    parts = max(1, -(-asked.count() // QUERIES))

    def dealt(df: DataFrame, own: str, other: str, owns: int, others: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(owns)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("n", F.size("v"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids, x = left.column("id").to_numpy(), vectors.matrix(left.column("v"))
            names, y = right.column("id").to_numpy(), vectors.matrix(right.column("v"))
            order = np.argsort(ids, kind="stable")
            for name, (own, score, _) in zip(names, Forest(ids[order], x[order], trees, depth).nearest(names, y, top, miss)):
                found.append((np.full(len(own), name), own, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    keys = ["block", "part", "n"]
    met = dealt(data, "block", "part", blocks, parts).groupBy(*keys).cogroup(dealt(asked, "part", "block", parts, blocks).groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def every(id_col: str, step: int) -> Column:
    """The rows whose id is divisible by ``step``."""
    return F.col(id_col) % step == 0
