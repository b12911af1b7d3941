"""Queries on titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import extract, titles
from docketry.plans.cases import CTE
from docketry.plans.registry import query
from docketry.session import ship
from docketry.sources.tables import cases, spread, table

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(CTE + r""" SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN regexp_replace(regexp_extract(t, '^IN RE: (.*)$', 1), '[,\s]*$', '') ELSE t END AS title FROM (SELECT doc_id, trim(string_split(clean_text, chr(10))[3]) AS t FROM cases)""")
def derived_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles derived from texts."""
    return cases(spark, folder).select("doc_id", titles.derived(F.col("clean_text")).alias("title"))


@query(CTE + r""" SELECT doc_id, trim(regexp_replace(case_title, '\s+', ' ', 'g')) AS title FROM cases""")
def title_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Titles freed of what was put around them."""
    noisy = F.concat(F.lit("PROMULGATED: EN BANC "), F.col("case_title"), F.lit(" DECISION PERALTA, J.: ,"))
    return cases(spark, folder).select("doc_id", titles.cleaned(noisy).alias("title"))


@query(CTE + r""" SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN regexp_extract(case_title, '^IN RE: (.*)$', 1) WHEN doc_id % 6 = 3 THEN regexp_extract(case_title, '^(.+?), COMPLAINANT', 1) || ', COMPLAINANT, VS. ' || regexp_extract(case_title, 'VS\. (.+)$', 1) || ', RESPONDENT' END AS title FROM cases""")
def admin_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of administrative cases."""
    line = F.when(F.col("doc_id") % 6 == 3, F.concat("case_title", F.lit(", RESPONDENT"))).otherwise(F.col("case_title"))
    return cases(spark, folder).select("doc_id", titles.admin_title(line).alias("title"))


@query(CTE + f""" SELECT doc_id, length(case_title) BETWEEN 10 AND 400 AND len(list_filter({_LIST(titles.BODY_PHRASES)}, lambda p: contains(lower(case_title), p))) = 0 AND len(list_filter({_LIST(titles.PROCEDURE_PHRASES)}, lambda p: contains(lower(case_title), p))) = 0 AS valid FROM cases""")
def title_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Which titles may stand."""
    return cases(spark, folder).select("doc_id", titles.valid(F.col("case_title")).alias("valid"))


@query(f"SELECT doc_id, len(list_filter({_LIST(titles.FACT_PHRASES)}, lambda p: contains(lower(text), p))) > 0 AS factual, len(list_filter({_LIST(titles.BODY_PHRASES)}, lambda p: contains(lower(text), p))) > 0 AS body FROM documents")
def factual_content(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts read like facts, and like running text."""
    return spread(table(spark, folder, "documents")).select("doc_id", titles.factual(F.col("text")).alias("factual"), titles.body_text(F.col("text")).alias("body"))


@query(CTE + r""" SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 6 = 4 THEN 'Case (' || coalesce(gr_number, special_number) || ')' WHEN doc_id % 7 = 0 THEN string_split(clean_text, chr(10))[3] ELSE case_title END AS title FROM cases""")
def display_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as displayed; without one a line of the text that names both sides stands in, or the number."""
    title = F.when(F.col("doc_id") % 7 != 0, F.col("case_title"))
    return cases(spark, folder).select("doc_id", titles.shown(title, F.col("clean_text"), F.col("gr_number"), F.col("special_number")).alias("title"))


@query()
def title_case(spark: SparkSession, folder: str) -> DataFrame:
    """Titles in title case."""
    return cases(ship(spark), folder).select("doc_id", titles.title_case(F.col("case_title")).alias("title"))


@query(CTE + r""" SELECT doc_id, (doc_id + 1) || '. **' || case_title || '** ' || CASE WHEN gr_number IS NULL THEN '**[' || special_number || '](am:' || regexp_extract(special_number, 'A\.M\.\s+No\.\s+([A-Z0-9\-]+)', 1) || ')**' ELSE '**[' || gr_number || '](gr:' || regexp_extract(gr_number, 'G\.R\.\s+No\.\s+([0-9\-]+)', 1) || ')**' END || chr(10) || lang AS item FROM cases""")
def listing_item(spark: SparkSession, folder: str) -> DataFrame:
    """Cases as items of a listing."""
    link = extract.number_link(extract.case_key(F.col("gr_number"), F.col("special_number"), F.lit("")))
    return cases(spark, folder).select("doc_id", titles.listing_item(F.col("doc_id") + 1, F.col("case_title"), link, F.col("lang")).alias("item"))
