"""Report on retrieval: how well a library answers a set of questions, against targets and an earlier run.

Every question is searched in the whole library by its words; its best
documents are scored by how much of the question's own passage they hold, in
single words and in pairs of words. A run has a name and writes only folders of
its own, so that runs stand side by side, and a run that is repeated replaces
itself.

Tables below the output folder: ``hits`` (item_id, rank, doc_id, score,
recall_1, recall_2, met) by run and language, and ``summary`` (lang, questions,
answered, hits, mean_recall_1, mean_recall_2, reciprocal_rank, on_target,
against) by run, for each language of the documents found and, as ``all``, over
all of them. ``met`` tells whether a document holds the target's share of the
passage's words, ``reciprocal_rank`` is the mean of 1 / rank of a question's
first document that does, 0 without one, and ``against`` is what that gained
on the baseline run, null without one.

Defined cases: a question without words, or whose words no document has, has no
hits and counts as unanswered; ids of questions and of documents must not
repeat; a null language is a partition of its own, ``none`` in the summary;
without any hit there is only the row ``all``.
"""

from __future__ import annotations

import argparse
import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import evaluate, search
from docketry.session import build
from docketry.sources import scratch
from docketry.sources.tables import spread
from jobs.settings import HERE, load, log, ready, write_folder, write_partitions

HITS = "item_id long, rank int, doc_id long, score double, recall_1 double, recall_2 double, met boolean, lang string"
SUMMARY = (
    "lang string, questions long, answered long, hits long, mean_recall_1 double, mean_recall_2 double, reciprocal_rank double, "
    "on_target boolean, against double, run string"
)
SETTINGS = {"hits": 10, "target_recall": 0.6, "target_share": 0.5}


def find(documents: DataFrame, questions: DataFrame, settings: dict) -> DataFrame:
    """The best documents of every question with their scores."""
    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = search.ranked(search.bm25(documents, asked, first=settings["hits"]), "doc_id", settings["hits"]).select("query_id", "doc_id", "rank", "score")
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("response"), "lang")
    # A few rows a question, against all texts; both recalls are counted in one pass.
    pairs = search.sized(scratch.table(best, "hits")).join(texts, F.col("doc_id") == F.col("_id")).join(asked.withColumnRenamed("query", "reference"), "query_id")
    scored = pairs.select("query_id", "doc_id", "rank", "score", "lang", evaluate.recalls(pairs, 1, 2).alias("r")).select("*", *(F.round(f"r.recall_{n}", 9).alias(f"recall_{n}") for n in (1, 2)))
    full = [F.coalesce(f"recall_{n}", F.lit(0.0)).alias(f"recall_{n}") for n in (1, 2)]
    met = F.coalesce("recall_1", F.lit(0.0)) >= settings["target_recall"]
    return scored.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", *full, met.alias("met"), "lang")


def summarise(hits: DataFrame, questions: int, settings: dict, baseline: DataFrame) -> DataFrame:
    """One row for each language and one for all; ``baseline`` has (lang, before)."""
    both = hits.select("*", F.explode(F.array(F.coalesce("lang", F.lit("none")), F.lit("all"))).alias("of"))
    each = both.groupBy("of", "item_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("recall_1").alias("r1"), F.sum("recall_2").alias("r2"), F.min(F.when(F.col("met"), F.col("rank"))).alias("first"))
    sums = each.groupBy("of").agg(F.count(F.lit(1)).alias("answered"), F.sum("hits").alias("hits"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2"), F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"))
    every = sums.unionByName(hits.sparkSession.sql("SELECT 'all' AS of"), allowMissingColumns=True).groupBy("of").agg(*(F.sum(c).alias(c) for c in ("answered", "hits", "r1", "r2", "rr")))
    n = F.lit(questions)
    rank = F.round(F.coalesce(F.try_divide("rr", n), F.lit(0.0)), 9)
    met = every.select(
        F.col("of").alias("lang"), n.cast("long").alias("questions"), F.coalesce("answered", F.lit(0)).cast("long").alias("answered"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.round(F.try_divide("r1", "hits"), 9).alias("mean_recall_1"), F.round(F.try_divide("r2", "hits"), 9).alias("mean_recall_2"), rank.alias("reciprocal_rank"), (rank >= settings["target_share"]).alias("on_target"),
    )
    return met.join(baseline, "lang", "left").select("*", F.round(F.col("reciprocal_rank") - F.col("before"), 9).alias("against")).drop("before")


def run(spark: SparkSession, documents: str, questions: str, output: str, name: str, baseline: str | None = None, settings: str = str(HERE / "retrieval_report.json")) -> None:
    """Write the run ``name`` over one of that name; ``baseline`` names an earlier run of the same output."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError("the name of a run is letters, digits, dots, dashes and underscores")
    chosen = load(spark, settings, SETTINGS)
    ready(spark, f"{output}/summary", SUMMARY, "run")
    library, asked = spark.read.parquet(documents).select("doc_id", "text", "lang"), spark.read.parquet(questions).select("item_id", "text")
    count = asked.count()
    log.info("reading %s and %s questions of %s with %s", documents, count, questions, chosen)
    # The run's folder as a whole, so that no language of a run before is left in it.
    write_folder(find(spread(library), asked, chosen), f"{output}/hits/run={name}", "lang")
    stored = spark.read.schema(HITS).parquet(f"{output}/hits/run={name}")
    before = spark.read.schema(SUMMARY).parquet(f"{output}/summary").where(F.col("run") == F.lit(baseline)).select("lang", F.col("reciprocal_rank").alias("before"))
    write_partitions(summarise(stored, count, chosen, before).withColumn("run", F.lit(name)), f"{output}/summary", "run")


def reports(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Hits and summaries of all runs."""
    return spark.read.schema(f"{HITS}, run string").parquet(f"{output}/hits"), spark.read.schema(SUMMARY).parquet(f"{output}/summary")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.retrieval_report", description=__doc__.split("\n")[0])
    parser.add_argument("documents", help="Parquet with doc_id, text and lang")
    parser.add_argument("questions", help="Parquet with item_id and text")
    parser.add_argument("output", help="folder of the tables hits and summary")
    parser.add_argument("name", help="name of this run")
    parser.add_argument("--baseline", help="name of an earlier run to compare with")
    parser.add_argument("--settings", default=str(HERE / "retrieval_report.json"))
    parser.add_argument("--master", default="local[*]")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build(given.master)
    try:
        run(spark, given.documents, given.questions, given.output, given.name, given.baseline, given.settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
