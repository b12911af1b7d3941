"""Joins of strings by parts they share: which contains which, and which are alike.

Both go through inverted lists of short runs of characters, so that no pair is
looked at that shares none.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import let
from docketry.operators.search import sized
from docketry.session import ship

#: Characters of a run by which a longer string is found.
RUN = 3
#: Parts, an id and a run each, that may go to every executor, so that the runs of the longer strings are not shuffled.
KEYS = 200_000


def runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, in order, with repeats."""

    def cut(chars: Column) -> Column:
        wide = F.size(chars) - size + 1
        joined = lambda i: F.concat(*(F.element_at(chars, i + k) for k in range(size)))
        return F.when(wide > 0, F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1))), joined)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), cut)


def containing(large: DataFrame, small: DataFrame) -> DataFrame:
    """(large_id, small_id) wherever ``text`` of large (large_id, text) contains ``part`` of small (small_id, part).

    A part is looked up by one run of its characters, the one that fewest
    parts have, and then verified. Parts longer than every string are left out,
    and strings are not shuffled with their runs. Ids of either side must not
    repeat with different strings; empty and null strings meet nothing.
    """
    longest = large.agg(F.max(F.length("text")).alias("_longest"))
    fitting = small.where("part <> ''").join(F.broadcast(longest), F.length("part") <= F.col("_longest")).drop("_longest")
    keyed = fitting.select("small_id", F.explode_outer(F.array_distinct(F.when(F.length("part") >= RUN, runs(F.col("part"), RUN)).otherwise(F.array("part")))).alias("run")).where("run is not null")
    rare = keyed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    keys = keyed.join(rare, "run").groupBy("small_id").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    own = large.where("text <> ''").select("large_id", F.explode_outer(F.array_distinct(F.concat(*(runs(F.col("text"), n) for n in range(1, RUN + 1))))).alias("run")).where("run is not null")
    # Ids alone meet; the strings join what is left.
    met = own.join(sized(keys, KEYS), "run").select("large_id", "small_id").distinct()
    return met.join(large, "large_id").join(fitting, "small_id").where(F.contains("text", F.col("part"))).select("large_id", "small_id").distinct()


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, ratio) of strings (left_id, a) and (right_id, b) whose likeness is at least ``least`` > 2 / 3.

    Likeness is twice the matched characters by the length of both, S. Two
    filters let no such pair go. The matched characters are within the shorter
    string, so the lengths differ by a bounded factor. And m matched characters
    lie in at most S - 2 m + 1 blocks, as each two are parted by an unmatched
    one, so at least 3 m - S - 1 pairs of neighbours are shared; for strings so
    short that this proves nothing, m single characters are.
    """
    ship(left.sparkSession)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b)])

    pairs = candidates(left, right, least)
    return pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least).select("left_id", "right_id", "ratio")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, a, right_id, b) of the pairs that pass both filters of ``alike``."""
    factor = (2 - least) / least
    # Below this sum of lengths shared neighbours are not proved.
    short = math.ceil(1 / (1.5 * least - 1)) + 1
    step = math.log(factor)

    def listed(df: DataFrame, name: str, c: str, n: int, around: list[int]) -> DataFrame:
        size = F.length(c)
        rows = df.where(F.col(c) != "").select(f"{name}_id", size.alias(f"{name}_size"), F.explode_outer(runs(F.col(c), n)).alias("run")).where("run is not null")
        rows = rows.where(F.col(f"{name}_size") < short) if n == 1 else rows
        counts = rows.groupBy(f"{name}_id", f"{name}_size", "run").agg(F.count(F.lit(1)).alias(f"{name}_n"))
        level = F.floor(F.log(F.col(f"{name}_size")) / step).cast("int")
        return counts.withColumn("level", F.explode(F.array(*(level + k for k in around))) if len(around) > 1 else level)

    def met(n: int) -> DataFrame:
        both = listed(left, "left", "a", n, [-1, 0, 1]).join(listed(right, "right", "b", n, [0]), ["level", "run"])
        total = F.col("left_size") + F.col("right_size")
        both = both.where((F.greatest("left_size", "right_size") <= factor * F.least("left_size", "right_size") + 1e-9) & ((total >= short) if n == 2 else (total < short)))
        need = (1.5 * least - 1) * total - 1 if n == 2 else 0.5 * least * total
        shared = both.groupBy("left_id", "right_id", "left_size", "right_size").agg(F.sum(F.least("left_n", "right_n")).alias("shared"))
        return shared.where(F.col("shared") >= need - 1e-9).select("left_id", "right_id")

    return met(2).unionByName(met(1)).join(left, "left_id").join(right, "right_id").select("left_id", "a", "right_id", "b")
