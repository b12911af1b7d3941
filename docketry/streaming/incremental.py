"""Incremental loads with Structured Streaming: new records once, upserts, bounded windows of metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.records import keep_new, upsert


def new_records(stream: DataFrame, key: str = "id", time: str | None = None, late: str = "30 days") -> DataFrame:
    """Each key once. With an event time the state is bounded by the watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append the records that the table at ``path`` lacks; a restart adds none twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if _exists(spark, path):
            rows = keep_new(rows, spark.read.parquet(path), key)
        rows.write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def upsert_into(stream: DataFrame, path: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Keep of each key the latest version in tables ``path``/batch=n; the last one is the state."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        # The batch before is the state but for one that was never written.
        last = next((m for m in range(n - 1, -1, -1) if _exists(spark, f"{path}/batch={m}")), None)
        stored = batch.limit(0) if last is None else spark.read.parquet(f"{path}/batch={last}")
        upsert(stored, batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, parts: int = 256) -> StreamingQuery:
    """Keep of each key the latest version, for a state that is large against a batch; ``merged`` reads it.

    The state is dealt by a hash of the key. A batch reads and writes only the
    parts that its keys fall into, as tables ``path``/batch=n/state_part=p; the
    newest of a part counts. Batch n reads only older ones, so it may be written
    again after a failure; whole batches are told by the _SUCCESS file that
    Spark writes last. ``parts`` must stay as it was first set.
    """

    def write(batch: DataFrame, n: int) -> None:
        keyed = batch.withColumn("state_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = {r[0] for r in keyed.select("state_part").distinct().collect()}  # at most ``parts``
        paths = [where for p, where in _newest_parts(batch.sparkSession, path, n, parts).items() if p in touched]
        stored = _read_parts(batch.sparkSession, paths) if paths else keyed.limit(0)
        upsert(stored, keyed, key, version).repartition("state_part").write.mode("overwrite").partitionBy("state_part").parquet(f"{path}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, parts: int = 256) -> DataFrame:
    """What ``merge_into`` keeps at ``path``, as of the last batch that was written whole; there must be one with rows."""
    return _read_parts(spark, list(_newest_parts(spark, path, None, parts).values())).drop("state_part")


def _read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parts of several batches as one table with ``state_part``; columns that a batch lacks are null."""
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/state_part=(\d+)/", 1).cast("int")
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("state_part", at)


def _newest_parts(spark: SparkSession, path: str, before: int | None, parts: int) -> dict[int, str]:
    """The newest folder of every part, from whole batches before ``before``."""
    fs, root = _file_system(spark, path)
    if not fs.exists(root):
        return {}
    number = lambda status: int(status.getPath().getName().split("=")[1])
    found: dict[int, str] = {}
    batches = sorted((s for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")), key=number, reverse=True)
    for batch in batches:
        if len(found) == parts:
            break
        inside = fs.listStatus(batch.getPath()) if before is None or number(batch) < before else []
        if any(s.getPath().getName() == "_SUCCESS" for s in inside):
            for s in inside:
                if s.getPath().getName().startswith("state_part="):
                    found.setdefault(number(s), s.getPath().toString())
    return found


def operation_windows(stream: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Count and durations of operations by window; late events count until the watermark passes."""
    by = F.window(time, size)
    return stream.withWatermark(time, late).groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table in memory; for small results and tests."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def store_once(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that an aggregated stream has now, as a table at ``path``; each batch holds the whole result and replaces the one before."""
    spark, schema = df.sparkSession, df.schema
    query = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def observed(df: DataFrame, name: str, record: Callable[[dict], None]) -> DataFrame:
    """``df`` whose row count goes to ``record`` when an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out.take_metrics = lambda: record(seen.get)
    return out


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)
