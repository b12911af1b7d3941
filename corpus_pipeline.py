"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common, linededup, ordinal, packing, registry, runindex, simhash


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier grades as good; what it rejects goes."""
    return ordinal.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before; one that loses all its lines goes."""
    return _measured(linededup.keep(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id."""
    return simhash.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long repeated strings; one of which nothing is left goes."""
    return _measured(runindex.keep(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in balanced sequences."""
    return packing.pack_documents(docs, registry.TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes from one to the next is written to the shared folder, and removed once read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = common.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, "stage")
            common.clean_since(spark, start, docs.cut_path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """Nothing: see ORACLE_SQL."""
    return {}
