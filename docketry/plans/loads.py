"""Queries of loads, lookups and reports, over files that they write first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import glossary, index, search
from docketry.plans.cases import CTE
from docketry.plans.registry import query
from docketry.sources import pages, records, scratch
from docketry.sources.tables import cases, table

#: Numbers that are looked up: plain, with a prefix, special, as an id, and one that no case has.
LOOKED_UP = ["100010", "G.R. No. 100004", "P-13-2903", "A.M. No. P-21-2908", "17", "nothing"]
_LOOKED_UP = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(LOOKED_UP)) + ") AS q(query_id, number)"


def _forms(field: str, prefixes: dict[str, list[str]]) -> str:
    return f"{field} IN (" + ", ".join(f"'{p}' || number" for p in prefixes[field.replace('CAST(doc_id AS VARCHAR)', 'id')]) + ")"


def _lookup_sql(prefixes: dict[str, list[str]]) -> str:
    met = " OR ".join(_forms(f, prefixes) for f in ("gr_number", "special_number", "CAST(doc_id AS VARCHAR)") if f.replace("CAST(doc_id AS VARCHAR)", "id") in prefixes)
    return CTE + f" SELECT CAST(query_id AS INTEGER) AS query_id, min(doc_id) AS doc_id FROM {_LOOKED_UP} JOIN cases ON {met} GROUP BY query_id"


def _looked_up(spark: SparkSession, folder: str, prefixes: dict[str, list[str]]) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(LOOKED_UP)), "query_id int, number string")
    return records.first_matches(cases(spark, folder).withColumn("id", F.col("doc_id").cast("string")), asked, "doc_id", prefixes).select("query_id", "doc_id")


@query(_lookup_sql(records.PREFIXES))
def case_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first case with each number, in any of the nineteen forms in which a record may hold it."""
    return _looked_up(spark, folder, records.PREFIXES)


@query(_lookup_sql(records.PLAIN))
def case_lookup_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The first case with each number or id as it is given."""
    return _looked_up(spark, folder, records.PLAIN)


@query(CTE + " SELECT doc_id, special_number, CAST(2 AS INTEGER) AS n FROM cases WHERE upper(special_number) = 'A.M. NO. P-13-2903'")
def special_number_upper(spark: SparkSession, folder: str) -> DataFrame:
    """Cases stored in capitals under a special number that is asked for as it is usually written."""
    shouted = cases(spark, folder).withColumn("special_number", F.upper("special_number"))
    found = records.first_form(shouted, "special_number", records.special_forms("A.M. No. P-13-2903"))
    return found.join(cases(spark, folder).select("doc_id", F.col("special_number").alias("own")), "doc_id").select("doc_id", F.col("own").alias("special_number"), F.col("form").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 25")
def bounded_load(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 valid records of files that have broken lines between them."""
    path = scratch.path(spark, "cases")
    docs = table(spark, folder, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("clean_text"))).alias("line"))
    broken = docs.select("doc_id", F.explode(F.array(F.lit("{broken"), F.lit(""), F.col("line"))).alias("value"))
    broken.repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id", F.length("value")).select("value").write.text(path)
    return records.read_first(spark, path, 25, "id string, clean_text string").select("id", F.md5(F.encode("clean_text", "utf-8")).alias("digest"))


@query("""SELECT 'term ' || item_id AS term, 'about ' || md5(text) AS definition, CAST(item_id % 6 AS INTEGER) AS importance, CASE WHEN item_id % 3 = 0 THEN 'first|second' ELSE '' END AS elements FROM benchmark""")
def glossary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of glossary files: one with a record of entries, one with a bare list, one that is neither."""
    return _glossary(spark, folder).select("term", "definition", "importance", F.array_join(F.coalesce("elements", F.array().cast("array<string>")), "|").alias("elements"))


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch.path(spark, "glossary")
    extra = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("first"), F.lit("second")))
    entry = F.struct(F.concat(F.lit("term "), F.col("item_id").cast("string")).alias("term"), F.concat(F.lit("about "), F.md5(F.encode("text", "utf-8"))).alias("definition"), (F.col("item_id") % 6).cast("int").alias("bar_importance"), extra.alias("elements"))
    rows = table(spark, folder, "benchmark").select((F.col("item_id") % 2).alias("half"), F.floor(F.col("item_id") / 100).alias("file"), F.to_json(entry).alias("entry"))
    listed = rows.groupBy("half", "file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("entry"), ","), F.lit("]")).alias("list"))
    value = F.when(F.col("half") == 0, F.concat(F.lit('{"entries":'), F.col("list"), F.lit("}"))).otherwise(F.col("list"))
    other = spark.createDataFrame([("not a glossary", -1, -1)], "value string, half long, file long")
    # A folder and so a file for each list, of a hundred entries at most.
    listed.select(value.alias("value"), "half", "file").unionByName(other).write.partitionBy("half", "file").text(path)
    return glossary.read(spark, f"{path}/*/*/*.txt")


@query("""SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'term ' || item_id || ': about ' || md5(text) WHEN 1 THEN 'term ' || item_id || ': about ' || md5(text) || CASE WHEN item_id % 3 = 0 THEN chr(10) || 'Elements:' || chr(10) || '- first' || chr(10) || '- second' ELSE '' END END AS answer FROM benchmark""")
def glossary_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Questions for definitions and elements of the entries of files; other questions are left to a search."""
    item = F.col("item_id").cast("string")
    asked = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("What is term "), item, F.lit("?"))).when(F.col("item_id") % 5 == 1, F.concat(F.lit("The elements of term "), item)).when(F.col("item_id") % 5 == 2, F.concat(F.lit("what is the ruling in G.R. No. "), item)).when(F.col("item_id") % 5 == 3, "People v. Dizon").otherwise("term")
    return glossary.respond(_glossary(spark, folder), table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("query")))


@query("""WITH q AS (SELECT CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS query_index, * FROM benchmark)
    SELECT query_index, text AS query, CASE item_id % 3 WHEN 0 THEN 'digest' WHEN 1 THEN 'ruling' ELSE CASE WHEN contains(lower(text), 'ruling') THEN 'ruling' ELSE 'facts' END END AS expected_type,
      CASE item_id % 3 WHEN 0 THEN 'Case Digest' WHEN 1 THEN 'Factual Q&A' ELSE 'Other' END || ' for Case ' || item_id || ' (2001)' AS description,
      CASE item_id % 4 WHEN 0 THEN 'G.R. No. ' || item_id WHEN 1 THEN 'A.C. No. ' || item_id ELSE 'Unknown' END AS case_number FROM q WHERE query_index BETWEEN 3 AND 20""")
def query_file_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Test questions 3 to 20 of files with a question on each line, in their normal form."""
    path = scratch.path(spark, "questions")
    item = F.col("item_id").cast("string")
    category = F.element_at(F.array(F.lit("Case Digest"), F.lit("Factual Q&A"), F.lit("Other")), (F.col("item_id") % 3 + 1).cast("int"))
    number, other = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("G.R. No. "), item)), F.when(F.col("item_id") % 4 == 1, F.concat(F.lit("A.C. No. "), item)).otherwise("x1")
    one = F.struct(F.col("text").alias("query"), category.alias("category"), F.lit("2001").alias("case_year"), F.concat(F.lit("Case "), item).alias("case_title"), other.alias("case_id"), number.alias("case_gr_number"))
    rows = table(spark, folder, "benchmark").select("item_id", F.to_json(one).alias("value"))
    rows.repartitionByRange(16, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    return records.read_query_lines(spark, path, 3, 20).select("query_index", "query", "expected_type", "description", "case_number")


@query("""SELECT 'test ' || conv_id || '.' || turn AS test_name, role AS status, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS query, '' AS year, '' AS category, '' AS case_number, CAST(length(text) AS INTEGER) AS response_length,
    CAST(0 AS DOUBLE) AS execution_time, '' AS timestamp, CAST(turn AS DOUBLE) / 4 AS rouge_1_f1, CAST(0 AS DOUBLE) AS rouge_2_f1, CAST(0 AS DOUBLE) AS rouge_l_f1, CAST(0 AS DOUBLE) AS bertscore_f1, CAST(0 AS DOUBLE) AS accuracy_score, '' AS accuracy_level, false AS quality_threshold_met, CAST(0 AS DOUBLE) AS content_relevance_score
    FROM (SELECT conv_id, turn, role, replace(replace(text, chr(10), ' '), chr(34), ' ') AS text FROM conversations)""")
def csv_report(spark: SparkSession, folder: str) -> DataFrame:
    """A report of tests as a CSV file of seventeen columns, read back."""
    path = scratch.path(spark, "report")
    plain = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(" "))
    tests = table(spark, folder, "conversations").select(F.concat(F.lit("test "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("test_name"), F.col("role").alias("status"), plain.alias("query"), F.length(plain).alias("response_length"), (F.col("turn").cast("double") / 4).alias("rouge_1_f1"))
    rows = records.report_rows(tests)
    records.write_report(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) if back.schema[c].dataType.typeName() == "string" else c for c in back.columns))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 2 = 0 GROUP BY user_id")
def newest_results(spark: SparkSession, folder: str) -> DataFrame:
    """Figures by user of the newest of several result files, exported as JSON and read back."""
    path = scratch.path(spark, "results")
    events = table(spark, folder, "events")
    for name, rows in (("run1", events.where("event_id % 2 = 1")), ("run2", events.where("event_id % 2 = 0"))):
        rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).coalesce(1).write.json(f"{path}/{name}")
    files = spark.read.schema("user_id long, n long, total double").json(f"{path}/*").withColumn("file", F.input_file_name())
    return records.newest(files).select("user_id", "n", "total")


@query("SELECT CAST(k AS INTEGER) AS run, CAST((SELECT count(*) FROM documents WHERE CASE k WHEN 0 THEN doc_id % 2 = 0 ELSE true END) AS BIGINT) AS cached, CAST((SELECT count(*) FROM documents WHERE CASE k WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN doc_id % 2 = 1 ELSE false END) AS BIGINT) AS made, k < 2 AS saved FROM range(3) t(k)")
def context_cache_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of contexts over three runs: kept between them, and saved only where it grew."""
    path = scratch.path(spark, "contexts")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("content"), "doc_id")
    told = []
    for k, rows in enumerate((docs.where("doc_id % 2 = 0"), docs, docs)):
        made, cached, saved = index.remember(spark, path, rows.select(F.md5(F.encode("content", "utf-8")).alias("key"), F.concat(F.lit("context of "), "content").alias("context")))
        told.append((k, cached, made, saved))
    return spark.createDataFrame(told, "run int, cached long, made long, saved boolean")


@query("SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 7 <> 3")
def collection_scroll(spark: SparkSession, folder: str) -> DataFrame:
    """Points put into a collection and read back, those without a payload left out."""
    path = scratch.path(spark, "collection")
    schema = "id string, payload struct<doc_id:bigint,lang:string>"
    index.create(spark, path, schema)
    docs = table(spark, folder, "documents")
    payload = F.when(F.col("doc_id") % 7 != 3, F.struct("doc_id", F.upper("lang").alias("lang")))
    docs.select(F.col("doc_id").cast("string").alias("id"), payload.alias("payload")).write.mode("append").parquet(f"{path}/points")
    if index.create(spark, path, schema):
        raise ValueError("a collection was made twice")
    return index.scroll(spark, path).select("payload.*")


@query("SELECT (SELECT count(*) FROM documents) AS total_chunks, (SELECT count(DISTINCT t) FROM (SELECT unnest(list_filter(string_split(regexp_replace(lower(lang || ' ' || source), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)) AS t FROM documents)) AS terms, (SELECT count(DISTINCT lang) FROM documents) AS cached_contexts, true AS bm25_available, false AS vectors_available")
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What a stored index holds."""
    path = scratch.path(spark, "index")
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"), "lang")
    index.build(docs, path)
    index.remember(spark, f"{path}/contexts", docs.select(F.col("lang").alias("key"), F.col("lang").alias("context")))
    return index.stats(spark, path)


@query("""SELECT doc_id, '' AS title, CASE doc_id % 3 WHEN 0 THEN 'body ' || doc_id WHEN 1 THEN 'text ' || doc_id ELSE '' END AS content, CASE WHEN doc_id % 2 = 0 THEN 'G.R. No. ' || doc_id ELSE '' END AS gr_number, CASE WHEN doc_id % 5 = 0 THEN 'facts' ELSE '' END AS section, CASE WHEN doc_id % 4 = 0 THEN 'factual' ELSE 'general' END AS section_type,
    CAST(doc_id % 10 AS DOUBLE) AS score, 'exact' AS match_type, CASE WHEN doc_id % 2 = 0 THEN 'G.R. No. ' || doc_id ELSE 'id' || doc_id END AS case_id, 'false' AS is_en_banc, lang AS other FROM documents""")
def hit_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of an index as documents: the first field with content counts, other fields become metadata."""
    item, k = F.col("doc_id").cast("string"), F.col("doc_id")
    pairs = {"content": F.lit(""), "body": F.when(k % 3 == 0, F.concat(F.lit("body "), item)), "text": F.when(k % 3 == 1, F.concat(F.lit("text "), item)), "gr_number": F.when(k % 2 == 0, F.concat(F.lit("G.R. No. "), item)), "id": F.concat(F.lit("id"), item), "section": F.when(k % 5 == 0, "facts"), "section_type": F.when(k % 4 == 0, "factual"), "other": F.col("lang")}
    payload = F.create_map(*(x for n, v in pairs.items() for x in (F.lit(n), v)))
    made = search.hit_documents(table(spark, folder, "documents").select("doc_id", (k % 10).cast("double").alias("score"), payload.alias("payload")), "exact")
    told = lambda n: F.try_element_at("metadata", F.lit(n)).alias(n)
    return made.select("doc_id", "title", "content", "gr_number", "section", "section_type", "score", "match_type", told("case_id"), told("is_en_banc"), told("other"))


@query("SELECT page_id, CAST(1 AS INTEGER) AS place, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/showdocs/1/' || page_id AS url FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, 2, 'https://other/showdocs/2' FROM pages WHERE page_id % 4 <> 0")
def box_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links to decisions within the list of titles of every page, made absolute; pages without the list have none."""
    inner = F.concat(F.lit('<a href="/else/1">x</a><a class="t" href="/showdocs/1/'), F.col("page_id").cast("string"), F.lit('">y</a><a href="https://other/showdocs/2">z</a>'))
    html = F.concat(F.lit('<a href="/showdocs/9">before</a>'), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit('<div id="container_title"><div>'), inner, F.lit('</div></div><a href="/showdocs/8">after</a>'))).otherwise(inner))
    return pages.decision_links(table(spark, folder, "pages").select("page_id", "url", html.alias("html")), box="container_title")


@query(r"""WITH b AS (SELECT page_id, url, coalesce(nullif(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), ''), '') AS nav, coalesce(html, '') AS html FROM pages),
    l AS (SELECT page_id, url, unnest(regexp_extract_all(nav || html, '(?is)<a\s[^>]*href="([^"]*)"', 1)) AS href FROM b)
    SELECT page_id, count(*) AS n, md5(string_agg(DISTINCT CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END, '|' ORDER BY CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END)) AS digest FROM l GROUP BY page_id""")
def framed_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every page's own html, put into a box with its menu in a box of its own: what the menu has counts twice."""
    html = F.coalesce("html", F.lit(""))
    menu = F.regexp_extract(html, r"(?s)<nav>(.*?)</nav>", 1)
    boxed = F.concat(F.lit('<div><div id="list"><div>'), menu, F.lit("</div>"), html, F.lit('</div><a href="/after">x</a></div>'))
    found = pages.decision_links(table(spark, folder, "pages").select("page_id", "url", boxed.alias("html")), mark="", box="list")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.encode(F.array_join(F.array_sort(F.collect_set("url")), "|"), "utf-8")).alias("digest"))


@query("SELECT page_id FROM pages WHERE length(html) >= 1000 AND NOT (contains(html, 'Supreme Court E-Library') AND length(html) < 2000) AND sha256(url) NOT IN (SELECT sha256(url) FROM pages WHERE page_id % 3 = 0)")
def pages_to_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are worth parsing and whose record is not stored yet."""
    rows = table(spark, folder, "pages").withColumn("id", F.sha2("url", 256))
    stored = rows.where("page_id % 3 = 0").select("id")
    return records.keep_new(rows.where(pages.worth_parsing(F.col("html"))), stored, "id").select("page_id")
