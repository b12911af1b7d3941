"""Windows that a stream keeps as state: the last rows by time, and tallies of trailing days.

Both deal rows to ``shards`` by a hash of their id, so that the state of a shard
is bounded and no operation, however frequent, meets in one task. A batch writes
anew the folders of the shards that it touched; a batch that is run again writes
the same. Rows may come late and in any order. Rows without a time or an id
count in no window. State lies in RocksDB, which keyed state of Python needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.session import ship

SHARDS = 8
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPERATION = "at long, event_id long, operation string, duration double"
TALLY = "operation string, day int, n long, total double"


def _plain(batch: pd.DataFrame) -> list[tuple]:
    """Rows of a batch as tuples, nulls as None."""
    return list(batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))


class LastRows(StatefulProcessor):
    """The ``most`` latest rows of a shard by time, equal times by id."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", OPERATION)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for batch in rows:
            kept = heapq.nlargest(self.most, kept + _plain(batch[["at", "event_id", "operation", "duration"]]), key=lambda r: r[:2])
        self.kept.put(kept)
        out = pd.DataFrame(kept, columns=["at", "event_id", "operation", "duration"])
        yield out.assign(shard=key[0])

    def close(self) -> None:
        pass


class Days(StatefulProcessor):
    """Count and durations by operation and day of a shard, of the ``days`` days up to its latest one."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tallies = handle.getMapState("tallies", "operation string, day int", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = {tuple(k): tuple(v) for k, v in self.tallies.iterator()}
        changed = set()
        for batch in rows:
            for (operation, day), g in batch.groupby(["operation", "day"], dropna=False)["duration"]:
                at = (None if pd.isna(operation) else operation, int(day))
                n, total = kept.get(at, (0, 0.0))
                kept[at] = (n + len(g), total + float(g.sum()))
                changed.add(at)
        oldest = max(day for _, day in kept) - self.days
        for at in [at for at in kept if at[1] <= oldest]:
            if self.tallies.containsKey(at):
                self.tallies.removeKey(at)
            del kept[at]
        for at in changed & kept.keys():
            self.tallies.updateValue(at, kept[at])
        yield pd.DataFrame([(o, d, n, t) for (o, d), (n, t) in kept.items()], columns=["operation", "day", "n", "total"]).assign(shard=key[0])

    def close(self) -> None:
        pass


def _dealt(stream: DataFrame, shards: int) -> DataFrame:
    told = stream.where("ts is not null and event_id is not null")
    return told.withColumn("shard", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int"))


def _keep(rows: DataFrame, processor: StatefulProcessor, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    spark = ship(rows.sparkSession)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        kept = rows.groupBy("shard").transformWithStateInPandas(processor, f"{schema}, shard int", "Update", "None")
        # A query takes the settings that the session has when it starts.
        return kept.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep_last(stream: DataFrame, path: str, checkpoint: str, most: int = 1000, shards: int = SHARDS) -> StreamingQuery:
    """Keep the last ``most`` operations (event_id, ts, operation, duration) of every shard at ``path``; ``last`` reads those of all."""
    rows = _dealt(stream, shards).select("shard", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), "operation", F.col("duration").cast("double").alias("duration"))
    return _keep(rows, LastRows(most), OPERATION, path, checkpoint)


def last(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """The last ``most`` operations of a stream, from the shards' own last ones."""
    rows = spark.read.schema(OPERATION).parquet(path).orderBy(F.desc("at"), F.desc("event_id")).limit(most)
    return rows.select(F.timestamp_micros("at").alias("ts"), "event_id", "operation", "duration")


def keep_days(stream: DataFrame, path: str, checkpoint: str, days: int = 90, shards: int = SHARDS) -> StreamingQuery:
    """Keep tallies of operations by day for the last ``days`` days at ``path``; ``trailing`` reads them."""
    rows = _dealt(stream, shards).select("shard", F.unix_date(F.col("ts").cast("date")).alias("day"), "operation", F.col("duration").cast("double").alias("duration"))
    return _keep(rows, Days(days), TALLY, path, checkpoint)


def trailing(spark: SparkSession, path: str, windows: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """(days, operation, n, total) of the days up to the latest one that any shard has seen, for each length."""
    tallies = spark.read.schema(TALLY).parquet(path).groupBy("operation", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    newest = tallies.agg(F.max("day").alias("newest"))
    within = tallies.crossJoin(F.broadcast(newest)).withColumn("days", F.explode(F.array(*map(F.lit, windows)))).where(F.col("day") > F.col("newest") - F.col("days"))
    return within.groupBy("days", "operation").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
