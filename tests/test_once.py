"""Costly steps are computed once a row, whatever reads them."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.plans import catalogue
from jobs import library_feed


def steps(df, what):
    """Steps of the plan that compute ``what``."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if what in line]


def test_sentences_of_a_feed_are_cut_once(spark):
    batch = spark.createDataFrame([(1, "One is here. Two is there.", "en")], library_feed.INPUT)
    records = library_feed.decide(batch, spark.createDataFrame([], "checksum string, first_id long"), 1)
    assert len(steps(library_feed.cut(batch, records, library_feed.SETTINGS), "split(")) == 1


def test_sentences_at_odd_ends(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(text.sentences(F.col("t"))).first()[0]
    assert cut(" \n\u000b A first sentence!\u000b\n Then U.S. law holds.  Not parted here. \t\n") == ["A first sentence!", "Then U.S. law holds.  Not parted here."]
    assert cut("A mark \u0003 is read as its letters. So it was before.") == ["A mark U.S. is read as its letters.", "So it was before."]
    assert cut(None) is None and cut(" ") == []


def test_sentences_of_all_chunks_are_cut_once(spark, tmp_path):
    spark.createDataFrame([(1, "One is here. Two is there.", "en")], library_feed.INPUT).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(steps(catalogue.queries()["chunk_totals"](spark, str(tmp_path)), "split(")) == 1


def scans(df, column):
    """Scans of files that read a column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line and f"{column}#" in line]


@pytest.mark.parametrize("name", ["combined_score", "bm25_topk", "bm25_all_documents", "picked_top5_unique"])
def test_texts_are_read_no_more_once_they_are_counted(spark, tmp_path, name):
    spark.createDataFrame([(1, "The tax of Acme", "en", "a"), (2, None, "en", "a"), (3, "the nothere", "en", "b")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()[name](spark, str(tmp_path))
    assert scans(spark.read.parquet(f"{tmp_path}/documents.parquet").select("text"), "text") and not scans(found, "text")
    assert found.count()
