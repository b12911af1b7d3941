"""Queries that bring records into the shapes that indexes, reports and models take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import display, extract
from docketry.plans.cases import CTE
from docketry.plans.registry import query
from docketry.sources import pages
from docketry.sources.tables import QUESTIONS_SQL, cases, questions, table

#: Fixed value: version of the payload.
CHUNK_VERSION = "v2.0"


@query(CTE + " SELECT doc_id, coalesce(gr_number, special_number, CAST(doc_id AS VARCHAR)) AS case_id, case_title AS title, coalesce(ponente, '') AS ponente, coalesce(promulgation_year, 0) AS year, 'v2.0' AS chunk_version FROM cases")
def chunk_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that go with every chunk; an empty string counts as missing."""
    key = extract.case_key(F.col("gr_number"), F.col("special_number"), F.col("doc_id").cast("string"))
    return cases(spark, folder).select("doc_id", key.alias("case_id"), F.col("case_title").alias("title"), F.coalesce("ponente", F.lit("")).alias("ponente"), F.coalesce("promulgation_year", F.lit(0)).alias("year"), F.lit(CHUNK_VERSION).alias("chunk_version"))


@query("SELECT doc_id, CASE WHEN length(lang || source) < 200 THEN lang || source || '. ' || substr(text, 1, 1800) ELSE substr(text, 1, 2000) END AS prepared FROM documents")
def classifier_input(spark: SparkSession, folder: str) -> DataFrame:
    """Title and beginning of a text for a classifier."""
    title = F.concat("lang", "source")
    both = F.when(F.length(title) < 200, F.concat(title, F.lit(". "), F.substring("text", 1, 1800))).otherwise(F.substring("text", 1, 2000))
    return table(spark, folder, "documents").select("doc_id", both.alias("prepared"))


@query("SELECT item_id, 'FACTS: ' || text || chr(10) || 'ISSUES: one; two' || chr(10) || 'RULING: granted' AS reference FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 1")
def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """References that are a text or a record of sections, whose lists are joined."""
    record = F.to_json(F.struct(F.col("text").alias("facts"), F.array(F.lit("one"), F.lit("two")).alias("issues"), F.lit("granted").alias("ruling")))
    stored = table(spark, folder, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, record).otherwise(F.col("text")).alias("raw"))
    parsed = F.from_json("raw", "facts string, issues array<string>, ruling string", {"mode": "PERMISSIVE"})
    parts = stored.withColumn("p", F.when(F.col("raw").startswith("{"), parsed))
    full = F.concat_ws("\n", F.concat(F.lit("FACTS: "), F.col("p.facts")), F.concat(F.lit("ISSUES: "), F.array_join("p.issues", "; ")), F.concat(F.lit("RULING: "), F.col("p.ruling")))
    return parts.select("item_id", F.when(F.col("p").isNull(), F.col("raw")).otherwise(full).alias("reference"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS label_id, CAST(i = label AS INTEGER) AS hot FROM embeddings, range(10) t(i)")
def multi_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all vectors as long rows of zeros and ones; ids out of range are left out."""
    labelled = table(spark, folder, "embeddings").select("vec_id", F.array("label").alias("labels"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("label_id"), F.array_contains("labels", i).cast("int").alias("hot")))
    return labelled.select("vec_id", F.explode(hot).alias("h")).select("vec_id", "h.label_id", "h.hot")


@query(CTE + " SELECT doc_id, 50.0::DOUBLE * (CAST(contains(lower(case_title), 'acme corporation') AS INTEGER) + CAST(contains(lower(case_title), 'nlrc 2') AS INTEGER)) AS score FROM cases")
def title_match_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty points for each party of a question that the title names."""
    names = extract.parties(F.lit("Acme Corporation vs NLRC 2"))
    low = F.lower("case_title")
    return cases(spark, folder).select("doc_id", (F.size(F.filter(names, lambda p: F.contains(low, p))) * 50.0).alias("score"))


@query(f"SELECT conv_id, turn, md5(CASE WHEN contains(lower(query), 'philippine') THEN query WHEN regexp_matches(lower(query), 'law|legal|court') THEN query || ' Philippines' ELSE query || ' Philippines law' END) AS digest FROM ({QUESTIONS_SQL})")
def query_enhancement(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of all messages for a search of the web."""
    return questions(spark, folder).select("conv_id", "turn", F.md5(F.encode(display.enhanced(F.col("query")), "utf-8")).alias("digest"))


@query("SELECT conv_id, turn, CAST(p AS INTEGER) AS place, CASE p WHEN 0 THEN 'system' ELSE 'user' END AS role, CASE p WHEN 0 THEN 'be brief' ELSE role END AS content FROM conversations, range(2) t(p)")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts taken apart by role."""
    prompt = F.concat(F.lit("System: be brief\nUser: "), F.col("role"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(display.messages(prompt)).alias("place", "m"))
    return rows.select("conv_id", "turn", "place", "m.role", "m.content")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(100000 + conv_id AS VARCHAR) END AS case_id FROM conversations")
def response_case(spark: SparkSession, folder: str) -> DataFrame:
    """The case that an answer links to."""
    linked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see **[G.R. No. x](gr:"), (F.col("conv_id") + 100000).cast("string"), F.lit(")**"))).otherwise("none")
    return table(spark, folder, "conversations").select("conv_id", "turn", display.case_of_response(linked).alias("case_id"))


@query("SELECT page_id, CAST(2000 + (page_id + y) % 20 AS INTEGER) AS year, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/month/' || page_id || '/' || y AS url FROM pages, range(3) t(y) WHERE 2000 + (page_id + y) % 20 BETWEEN 2004 AND 2015")
def month_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Links below the headings of some years within the list of dates, made absolute; links outside it do not count."""
    page = F.col("page_id").cast("string")
    one = lambda y: F.concat(F.lit("<h2> "), (F.lit(2000) + (F.col("page_id") + y) % 20).cast("string"), F.lit('</h2><a class="m" href="/month/'), page, F.lit(f'/{y}">Jan</a>'))
    html = F.concat(F.lit('<a href="/before">x</a><h2>2010</h2><div class="list" id="container_date"><div>'), one(0), F.lit("</div><DIV class='in'><div></div>"), one(1), F.lit("</DIV>"), one(2), F.lit('</div><a href="/after">y</a>'))
    rows = table(spark, folder, "pages").select("page_id", F.explode(pages.months(html, F.col("url"), 2004, 2015)).alias("m"))
    return rows.select("page_id", "m.year", "m.url")


@query("SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_both, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS n_missing FROM (SELECT doc_id, list_distinct(string_split(substr(text, 1, length(text) // 2), ' ')) AS a, list_distinct(string_split(substr(text, length(text) // 2 + 1), ' ')) AS b FROM documents)")
def term_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the two halves of every whole text share, and those of the first that the second lacks."""
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = (F.array_distinct(F.split(t, " ")) for t in (F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))))
    return table(spark, folder, "documents").select("doc_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_missing"))
