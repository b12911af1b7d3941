"""Feed a library: new documents become records and chunks that are ready for an index.

A stream takes the files of a folder that no run before has taken, as its
checkpoint tells. Every document gets a record: ``new``, ``short`` if it has too
few characters to index, or ``duplicate`` of the document that first had the
same text, in this batch or in an earlier one. New ones are cut into chunks of
whole sentences.

Tables below the output folder, by batch and language: ``records`` (doc_id,
checksum, status, first_id, n_chars) and ``chunks`` (chunk_id, doc_id,
checksum, chunk_index, token_count, content). A batch writes only partitions of its own
number and looks only at records of smaller ones, so a batch that is run again
after a failure writes the same rows over the old ones.

Defined cases: a null text is short; rows that repeat id and text within a
batch are one; an id that comes again with another text is a new version, and
``current`` gives the latest; a null language is a partition of its own.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import chunks
from docketry.session import build
from jobs.settings import HERE, load, log, ready, write_partitions

INPUT = "doc_id long, text string, lang string"
RECORDS = "doc_id long, checksum string, status string, first_id long, n_chars long, batch long, lang string"
CHUNKS = "chunk_id string, doc_id long, checksum string, chunk_index int, token_count int, content string, batch long, lang string"
SETTINGS = {"least_characters": 500, "chunk_tokens": 640, "overlap_tokens": 96, "least_tokens": 200, "files_per_batch": 256}


def decide(batch: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Records of a batch without its number; ``known`` has (checksum, first_id) of the new texts of earlier batches."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = batch.select("doc_id", "lang", text.tagged_sha256(F.col("text")).alias("checksum"), n.alias("n_chars"))
    rows = rows.groupBy("doc_id", "checksum").agg(F.min("lang").alias("lang"), F.max("n_chars").alias("n_chars"))
    long_enough = F.col("checksum").isNotNull() & (F.col("n_chars") >= least)
    # One row for each text, so that copies of one may be any share of the rows.
    own = rows.where(long_enough).groupBy("checksum").agg(F.min("doc_id").alias("own_id"))
    # Only what the batch asks for leaves the library's records, and is little where a batch is.
    seen = known.join(own.select("checksum"), "checksum", "left_semi").groupBy("checksum").agg(F.min("first_id").alias("known_id"), F.lit(True).alias("seen"))
    owners = own.join(seen, "checksum", "left").select("checksum", F.coalesce("known_id", "own_id").alias("first_id"), F.col("seen").isNull().alias("fresh"))
    met = rows.join(owners, "checksum", "left")
    status = F.when(F.col("fresh").isNull(), "short").when(F.col("fresh") & F.col("first_id").eqNullSafe(F.col("doc_id")), "new").otherwise("duplicate")
    return met.select("doc_id", "checksum", status.alias("status"), "first_id", "n_chars", "lang")


def cut(batch: DataFrame, records: DataFrame, settings: dict) -> DataFrame:
    """Chunks of the new documents among ``records``."""
    new = records.where("status = 'new'").select("doc_id", "checksum", "lang")
    texts = batch.select(F.col("doc_id").alias("_id"), text.tagged_sha256(F.col("text")).alias("_checksum"), "text").dropDuplicates(["_id", "_checksum"])
    own = texts.join(new, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_checksum") == F.col("checksum")))
    # Sentences are a column of their own: windows use them more than once.
    parted = own.withColumn("parts", text.sentences(F.col("text")))
    pieces = chunks.windows(F.col("parts"), settings["chunk_tokens"], settings["overlap_tokens"], settings["least_tokens"])
    made = parted.select("doc_id", "checksum", "lang", F.posexplode_outer(pieces).alias("chunk_index", "content")).where("content is not null")
    name = F.concat_ws("_", "checksum", F.col("chunk_index").cast("string"))
    return made.select(text.uuid5(name).alias("chunk_id"), "doc_id", "checksum", "chunk_index", text.token_estimate(F.col("content")).alias("token_count"), "content", "lang")


def take(batch: DataFrame, number: int, output: str, settings: dict) -> None:
    """Write the records and chunks of one batch, over those of an attempt that failed."""
    spark = batch.sparkSession
    stored = spark.read.schema(RECORDS).parquet(f"{output}/records")
    known = stored.where((F.col("batch") < number) & (F.col("status") == "new")).select("checksum", "first_id")
    records = decide(batch, known, settings["least_characters"]).withColumn("batch", F.lit(number).cast("long"))
    log.info("batch %s: records", number)
    write_partitions(records, f"{output}/records", "batch", "lang")
    own = spark.read.schema(RECORDS).parquet(f"{output}/records").where(F.col("batch") == number)
    log.info("batch %s: chunks", number)
    write_partitions(cut(batch, own, settings).withColumn("batch", F.lit(number).cast("long")), f"{output}/chunks", "batch", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: str = str(HERE / "library_feed.json")) -> None:
    """Take what is new among the Parquet files of ``documents``, a folder or pattern, and wait until it is written."""
    chosen = load(spark, settings, SETTINGS)
    ready(spark, f"{output}/records", RECORDS, "batch", "lang")
    ready(spark, f"{output}/chunks", CHUNKS, "batch", "lang")
    log.info("reading %s with %s", documents, chosen)
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(lambda batch, n: take(batch, n, output, chosen)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for progress in query.recentProgress:
        log.info("batch %s read %s rows", progress["batchId"], progress["numInputRows"])


def current(spark: SparkSession, output: str) -> DataFrame:
    """The latest record of every document with its chunks: one row for each chunk, or one without for a record that has none."""
    records = spark.read.schema(RECORDS).parquet(f"{output}/records")
    latest = Window.partitionBy("doc_id").orderBy(F.desc("batch"), F.desc("checksum"))
    newest = records.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "batch")
    cut_ones = spark.read.schema(CHUNKS).parquet(f"{output}/chunks").select("chunk_id", F.col("checksum").alias("_checksum"), F.col("doc_id").alias("_id"), "chunk_index", "token_count", "content")
    own = (F.col("checksum") == F.col("_checksum")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return newest.join(cut_ones, own, "left").drop("_checksum", "_id")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.library_feed", description=__doc__.split("\n")[0])
    parser.add_argument("documents", help="folder or pattern of Parquet files with doc_id, text and lang")
    parser.add_argument("output", help="folder of the tables records and chunks")
    parser.add_argument("checkpoint", help="folder of the stream's checkpoint; it belongs to the output")
    parser.add_argument("--settings", default=str(HERE / "library_feed.json"))
    parser.add_argument("--master", default="local[*]")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build(given.master)
    try:
        run(spark, given.documents, given.output, given.checkpoint, given.settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
