"""Reading and writing records as JSON lines and tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.sources.pages import decision_links

#: Fixed schema of a case record.
CASE = (
    "id string, gr_number string, gr_numbers array<string>, special_number string, special_numbers array<string>, case_title string, page_title string, "
    "promulgation_date string, promulgation_year int, promulgation_month string, court string, source_url string, clean_version string, checksum string, "
    "crawl_ts string, ponente string, division string, en_banc boolean, clean_text string, sections map<string,string>, has_gr_number boolean, "
    "has_special_number boolean, case_type string, case_subtypes array<string>, case_subtype string, "
    "quality_metrics struct<has_ruling:boolean,text_length:int,sections_extracted:int,has_structured_sections:boolean>"
)

__all__ = ["CASE", "append_json", "decision_links", "first_match", "first_matches", "keep_new", "lines", "newest", "read_cases", "read_first", "read_json_files", "read_queries", "read_query_lines", "report_rows", "sliced", "upsert", "write_report"]


def read_cases(spark: SparkSession, path: str, schema: str = CASE, partitions: int | None = None) -> DataFrame:
    """Case records of JSON lines, plain or gzipped; blank and malformed lines are skipped.

    A gzipped file is one task, so ``partitions`` spreads what follows.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.repartition(partitions) if partitions else rows


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, one document or list each, with the file they come from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def newest(files: DataFrame) -> DataFrame:
    """Rows of the file whose name is the greatest."""
    last = files.agg(F.max("file").alias("last"))
    return files.join(F.broadcast(last), F.col("file") == F.col("last")).drop("last")


def append_json(df: DataFrame, path: str) -> None:
    """Append as gzipped JSON lines."""
    df.write.mode("append").option("compression", "gzip").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV report with a header; long questions are cut."""
    cut = [F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(F.col(c)).alias(c) if c == "query" else F.col(c) for c in df.columns]
    df.select(*cut).write.mode("overwrite").option("header", True).csv(path)


#: Prefixes under which each field of a record may hold a number that is asked for.
PREFIXES = {
    "gr_number": ["", "G.R. No. ", "GR No. ", "A.M. No. ", "A.M. ", "A.C. No. ", "A.C. "],
    "special_number": ["", "A.M. No. ", "A.M. ", "A.C. No. ", "A.C. ", "OCA No. ", "U.C. No. ", "ADM No. ", "B.M. No. ", "LRC No. ", "SP No. "],
    "id": [""],
}
#: The same where only the id and the number itself count.
PLAIN = {"gr_number": [""], "id": [""]}


def first_match(cases: DataFrame, number: str, *order: Column, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """The first record whose number or id is the one asked for, in any of its forms."""
    met = functools.reduce(lambda a, b: a | b, (F.col(c).isin([p + number for p in ps]) for c, ps in (prefixes or PREFIXES).items()))
    return cases.where(met).orderBy(*order).limit(1)


def first_matches(cases: DataFrame, numbers: DataFrame, order: str, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """The first record for each of many numbers (query_id, number), by one join over all their forms."""
    prefixes = prefixes or PREFIXES
    forms = F.array(*(F.struct(F.lit(c).alias("field"), F.concat(F.lit(p), F.col("number")).alias("value")) for c, ps in prefixes.items() for p in ps))
    asked = numbers.select("query_id", F.explode(forms).alias("form")).select("query_id", "form.*")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in prefixes))
    own = cases.select(F.col(order).alias("_order"), F.struct(*cases.columns).alias("_record"), F.explode(fields).alias("_form"))
    met = own.join(asked, (F.col("_form.field") == F.col("field")) & (F.col("_form.value") == F.col("value")))
    return met.groupBy("query_id").agg(F.min_by("_record", "_order").alias("record")).select("query_id", "record.*")


def special_forms(number: str) -> list[str]:
    """A special number as it is given, in capitals and in small letters."""
    return list(dict.fromkeys([number, number.upper(), number.lower()]))


def first_form(cases: DataFrame, field: str, forms: list[str]) -> DataFrame:
    """Records whose field has one of some forms, of the first form only that any record has; ``form`` counts from 1."""
    place = F.array_position(F.array(*map(F.lit, forms)), F.col(field)).cast("int")
    met = cases.where(F.col(field).isin(forms)).withColumn("form", place)
    return met.join(met.agg(F.min("form").alias("form")), "form")


def lines(spark: SparkSession, path: str | list[str], files: list[str] | None = None) -> DataFrame:
    """Lines of text files (value) with their place: file, start of the split, and a number that grows within the split."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # Below the numbering, so that other files are not opened.
    read = read.where(F.col("_file").isin(files)) if files is not None else read
    return read.withColumn("_line", F.monotonically_increasing_id())


#: Rows of a slice up to which its splits are looked up first, so that only their files are read again.
SLICE = 10_000


def sliced(spark: SparkSession, path: str, first: int, last: int, valid: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows ``first`` to ``last``, counted from 1 over all files in order of their names and lines, with their ``place``.

    ``valid`` takes lines and leaves those that count, with their places. They
    are counted by split, and the counts added up, a row a split; of the lines
    only those in splits that hold a part of the slice are numbered, each split
    by itself. No line leaves its task for the counts.
    """
    split = ["_file", "_start"]
    counts = valid(lines(spark, path)).groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    near = counts.select(*split, "_n", before).where((F.col("_before") < last) & (F.col("_before") + F.col("_n") >= first)).drop("_n")
    files = None
    if last - first < SLICE:
        held = near.collect()  # each holds a row of the slice
        files = sorted({r["_file"] for r in held})
        near = F.broadcast(spark.createDataFrame(held, near.schema))
    within = F.row_number().over(Window.partitionBy(*split).orderBy("_line"))
    numbered = valid(lines(spark, path, files)).join(near, split).withColumn("place", F.col("_before") + within)
    return numbered.where(F.col("place").between(first, last)).drop(*split, "_line", "_before")


def read_first(spark: SparkSession, path: str, n: int, schema: str = CASE) -> DataFrame:
    """The first ``n`` valid records of JSON lines, in the order of files and lines.

    Files are opened in growing numbers, in order of their names, until they
    hold enough; each task hands on its first ``n`` at most.
    """
    files = sorted(spark.read.text(path).inputFiles())
    many = 4
    while True:
        told = lines(spark, files[:many] if files else path).where(F.trim("value") != "")
        parsed = told.withColumn("r", F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
        found = parsed.where(F.col("r").isNotNull() & F.col("r._broken").isNull()).orderBy("_file", "_start", "_line").limit(n).select("r.*").drop("_broken")
        if many >= len(files) or found.count() >= n:
            return found
        many *= 4


QUESTION = "query string, category string, case_year string, case_title string, case_id string, case_gr_number string, ground_truth string"


def read_queries(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Test questions ``first`` to ``last``, counted from 1, of a file that lists them all in one document, in their normal form."""
    files = spark.read.text(path, wholetext=True)
    listed = files.select(F.posexplode(F.from_json("value", f"struct<queries:array<struct<{', '.join(':'.join(f.split()) for f in QUESTION.split(','))}>>>")["queries"]).alias("place", "q"))
    return _questions(listed.where(F.col("place").between(first - 1, last - 1)).select((F.col("place") + 1).alias("query_index"), "q.*"))


def read_query_lines(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The same of files with a question on each line; blank and malformed lines do not count."""

    def valid(told: DataFrame) -> DataFrame:
        parsed = told.where(F.trim("value") != "").withColumn("q", F.from_json("value", QUESTION + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
        return parsed.where(F.col("q").isNotNull() & F.col("q._broken").isNull()).drop("value")

    return _questions(sliced(spark, path, first, last, valid).select(F.col("place").cast("int").alias("query_index"), "q.*").drop("_broken"))


def _questions(kept: DataFrame) -> DataFrame:
    """Questions in their normal form.

    The number of a case is the one given, else an id that looks like one; what
    is expected follows from the category and the question.
    """
    low, asked = F.lower(F.coalesce("category", F.lit(""))), F.lower(F.coalesce("query", F.lit("")))
    expected = F.when(F.contains(low, F.lit("digest")), "digest").when(low.rlike("factual|q&a|qa") | F.contains(asked, F.lit("ruling")), "ruling").otherwise("facts")
    number = F.coalesce(F.nullif("case_gr_number", F.lit("")), F.when(F.col("case_id").rlike(r"G\.R\.|A\.C\.|A\.M\."), F.col("case_id")), F.lit("Unknown"))
    told = F.concat(F.coalesce("category", F.lit("")), F.lit(" for "), F.coalesce("case_title", F.lit("")), F.lit(" ("), F.coalesce("case_year", F.lit("")), F.lit(")"))
    return kept.select("query_index", "query", expected.alias("expected_type"), told.alias("description"), number.alias("case_number"), "case_id", "ground_truth")


#: Columns of a report of tests, and what stands where a score is missing.
REPORT = [
    "test_name", "status", "query", "year", "category", "case_number", "response_length", "execution_time", "timestamp", "rouge_1_f1", "rouge_2_f1", "rouge_l_f1",
    "bertscore_f1", "accuracy_score", "accuracy_level", "quality_threshold_met", "content_relevance_score",
]


def report_rows(tests: DataFrame) -> DataFrame:
    """Rows of a report: its seventeen columns in order, with a default for each that ``tests`` lacks or leaves null."""
    has = {c.lower() for c in tests.columns}
    zero = {"response_length": F.lit(0), "quality_threshold_met": F.lit(False)} | {c: F.lit(0.0) for c in REPORT if c.endswith(("_f1", "_score")) or c == "execution_time"}
    return tests.select(*((F.coalesce(F.col(c), zero.get(c, F.lit(""))) if c in has else zero.get(c, F.lit(""))).alias(c) for c in REPORT))


def keep_new(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Both together, of each key the latest version.

    Of equal versions the batch's wins, and within a batch the row with the
    greatest digest. Rows are combined before the shuffle, so that one key may
    hold any share of them.
    """
    both = stored.withColumn("_place", F.lit(0)).unionByName(batch.withColumn("_place", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_place"]
    digest = F.xxhash64(*(name for name, kind in both.dtypes if name != "_place" and "map<" not in kind))
    latest = F.max_by(F.struct(*columns), F.struct(version, "_place", digest))
    return both.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")
