"""Running sums over groups of any size, in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.sources import scratch


def running(df: DataFrame, by: str, order: list[Column], sums: dict[str, str], most: dict[str, float] | None = None) -> DataFrame:
    """``df`` with the running sums ``sums`` (new name: column) of each group in order, each row's own value included.

    Rows are dealt by ranges of group and order and written so; sums of what a
    group has in each range, added up in front of every range, make the sums
    within a range whole. A group that holds any share of the rows is thus many
    tasks, and only one row for each range and group meets its like. ``order``
    must tell the rows of a group apart. ``most`` names sums, of values that are
    not negative, that need not be followed beyond a bound: ranges that begin
    above it are left out.
    """
    dealt = df.repartitionByRange(F.col(by), *order).withColumn("_range", F.spark_partition_id())
    held = scratch.table(dealt, "running")
    each = held.groupBy("_range", by).agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    fronts = each.select(F.col("_range").alias("_r"), F.col(by).alias("_by"), *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    for name, bound in (most or {}).items():
        fronts = fronts.where(F.col(f"_{name}") <= bound)
    within = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = held.join(fronts, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return own.select(*df.columns, *((F.sum(c).over(within) + F.col(f"_{name}")).alias(name) for name, c in sums.items()))
