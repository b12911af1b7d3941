"""Queries that run as streams over the tables, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.plans.registry import query
from docketry.sources import records, scratch
from docketry.sources.tables import table
from docketry.streaming import incremental, kept


@query("SELECT doc_id, n_chars, lang FROM documents")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents appended as gzipped JSON lines and read back."""
    path = scratch.path(spark, "jsonl")
    records.append_json(table(spark, folder, "documents").select("doc_id", "n_chars", "lang"), path)
    return records.read_cases(spark, path, "doc_id long, n_chars long, lang string")


@query("SELECT DISTINCT user_id FROM events")
def stream_new_records(spark: SparkSession, folder: str) -> DataFrame:
    """Users as they first occur in a stream of events, appended once."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").select("user_id")
    sink = scratch.path(spark, "users")
    incremental.append_new(stream, sink, scratch.path(spark, "state"), "user_id").awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Latest event of every user, kept up by a stream."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").select("user_id", "event_id")
    sink = scratch.path(spark, "latest")
    incremental.merge_into(stream, sink, scratch.path(spark, "state"), "user_id", "event_id", parts=16).awaitTermination()
    return incremental.merged(spark, sink, parts=16).select("user_id", "event_id")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type from a stream with a watermark; the result has a row per day and type."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.store_once(incremental.operation_windows(stream), scratch.path(spark, "windows"), scratch.path(spark, "state"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n")


def _operations(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events as operations."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("value").alias("duration"))


@query("SELECT operation, CAST(count(*) AS BIGINT) AS n, round(avg(duration), 6) AS avg_duration FROM (SELECT event_type AS operation, value AS duration FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY operation")
def stream_last_1000(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the last thousand operations of a stream, which keeps them as state."""
    sink = scratch.path(spark, "last")
    kept.keep_last(_operations(spark, folder), sink, scratch.path(spark, "state")).awaitTermination()
    return kept.last(spark, sink).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("avg_duration"))


@query("""SELECT CAST(w.days AS INTEGER) AS days, event_type AS operation, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total
    FROM events, (VALUES (7), (30), (90)) AS w(days), (SELECT max(CAST(ts AS DATE)) AS newest FROM events) WHERE CAST(ts AS DATE) > newest - w.days GROUP BY ALL""")
def stream_trailing_days(spark: SparkSession, folder: str) -> DataFrame:
    """Operations of the last 7, 30 and 90 days of a stream, which keeps tallies by day as state."""
    sink = scratch.path(spark, "days")
    kept.keep_days(_operations(spark, folder), sink, scratch.path(spark, "state")).awaitTermination()
    return kept.trailing(spark, sink).withColumn("total", F.round("total", 4))
