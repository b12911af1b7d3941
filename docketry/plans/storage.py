"""Queries of sources and sinks, pages, display and the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import display, text
from docketry.operators import glossary
from docketry.plans.cases import CTE
from docketry.plans.registry import query
from docketry.sources import pages, records
from docketry.sources.tables import QUESTIONS_SQL, cases, questions, table


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of pages."""
    return table(spark, folder, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, CAST(count(*) AS BIGINT) AS n_links, min(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN host || href ELSE host || '/' || href END) AS first_url FROM l GROUP BY page_id""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of pages, made absolute."""
    found = table(spark, folder, "pages").select("page_id", "url", F.explode(pages.links(F.col("html"))).alias("href"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.min(pages.absolute(F.col("href"), F.col("url"))).alias("first_url"))


@query("SELECT page_id, length(html) >= 1000 AND NOT (contains(html, 'Supreme Court E-Library') AND length(html) < 2000) AS worth FROM pages")
def page_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Which pages are worth parsing."""
    return table(spark, folder, "pages").select("page_id", pages.worth_parsing(F.col("html")).alias("worth"))


@query("SELECT url, page_id, CAST(2000 + page_id % 9 AS INTEGER) AS year FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS url FROM pages UNION ALL SELECT page_id, url FROM pages)) WHERE n = 1")
def dedupe_first_url(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses from two listings, each once, with the year of the listing that had it first."""
    listed = table(spark, folder, "pages").select("page_id", "url", (F.col("page_id") % 9 + 2000).cast("int").alias("year"))
    fronts = listed.withColumn("url", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1))
    return pages.first_by_url(fronts.unionByName(listed), F.asc("page_id")).select("url", "page_id", "year")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not stored yet."""
    return records.keep_new(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of events by user; of each the latest stays."""
    events = table(spark, folder, "events").select("user_id", "event_id", "value")
    return records.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '42'), doc_id LIMIT 100")
def sample_deterministic(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred documents, the same in every run."""
    return table(spark, folder, "documents").orderBy(F.md5(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit("42")), "utf-8")), "doc_id").limit(100).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of events."""
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT item_id, CAST(item_id + 1 AS BIGINT) AS place FROM benchmark WHERE item_id + 1 BETWEEN 5 AND 20")
def query_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Test questions from the fifth to the twentieth, both included."""
    rows = table(spark, folder, "benchmark").withColumn("place", F.col("item_id") + 1)
    return rows.where(F.col("place").between(5, 20)).select("item_id", "place")


_RELEVANCE_SQL = r"""10.0::DOUBLE + CASE WHEN regexp_matches(lower({0}), 'elibrary\.judiciary\.gov\.ph|sc\.judiciary\.gov\.ph|lawphil\.net') THEN 20.0 ELSE 0.0 END + CASE WHEN contains(lower({0}), '.gov.ph') THEN 15.0 ELSE 0.0 END
    + CASE WHEN regexp_matches(lower(html), 'supreme court|decision|ruling|case') THEN 10.0 ELSE 0.0 END"""
#: The same page on one of two official sites. Both SQL dialects read it.
_MIRROR_SQL = "CASE WHEN page_id % 2 = 0 THEN concat('https://www.lawphil.net/', page_id) ELSE concat('https://www.sc.gov.ph/', page_id) END"


@query(f"SELECT page_id, {_RELEVANCE_SQL.format('url')} AS score, {_RELEVANCE_SQL.format('mirror')} AS mirrored FROM (SELECT *, {_MIRROR_SQL} AS mirror FROM pages)")
def web_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance of all pages as results from the web, where they are and on an official site."""
    score = lambda url: display.web_relevance(url, F.col("html"))
    return table(spark, folder, "pages").select("page_id", score(F.col("url")).alias("score"), score(F.expr(_MIRROR_SQL)).alias("mirrored"))


@query(f"SELECT page_id, replace(regexp_extract(url, '^https?://([^/?#]+)', 1), 'www.', '') AS site, CASE page_id % 2 WHEN 0 THEN 'LawPhil' ELSE 'sc.gov.ph' END AS mirror FROM pages")
def source_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Sites of all pages by name, and of the same on an official site."""
    return table(spark, folder, "pages").select("page_id", display.site(F.col("url")).alias("site"), display.site(F.expr(_MIRROR_SQL)).alias("mirror"))


@query(r"SELECT page_id, md5(trim(replace(replace(regexp_replace(html, '\s+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'))) AS digest FROM pages")
def snippet_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets in one line."""
    return table(spark, folder, "pages").select("page_id", F.md5(F.encode(display.plain_snippet(F.col("html")), "utf-8")).alias("digest"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace(trim(regexp_replace(regexp_replace('[INST] Based on my knowledge, ' || text || ' However, please note that x', '\[/?(INST|SYS|USER|ASSISTANT)\]', '', 'g'), '(?is)\s+However,? please note that.*$', ''), ' ' || chr(10)), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) AS digest FROM conversations""")
def clean_response(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of all messages without instruction marks, disclaimers and runs of empty lines."""
    raw = F.concat(F.lit("[INST] Based on my knowledge, "), F.col("text"), F.lit(" However, please note that x"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(F.encode(display.clean_response(raw), "utf-8")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split('**Title**' || chr(10) || '- item' || chr(10) || '**[G.R. No. 1](gr:1)**' || chr(10) || text, chr(10))) AS line FROM documents)
    SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^\*\*[^*]+\*\*:?$|^#{1,3} ') AND NOT regexp_matches(line, '\]\(gr:') THEN 'heading' WHEN regexp_matches(trim(line), '^[-*•] ') THEN 'bullet' WHEN regexp_matches(line, '\*\*\[[^\]]+\]\((gr|am|https?):[^)]+\)\*\*') THEN 'link' ELSE 'paragraph' END AS kind, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL""")
def richtext_line_types(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of lines of answers."""
    full = F.concat(F.lit("**Title**\n- item\n**[G.R. No. 1](gr:1)**\n"), F.col("text"))
    lines = table(spark, folder, "documents").select(F.explode(F.split(full, "\n")).alias("line"))
    return lines.groupBy(display.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Benchmark items as entries of a glossary: their first words are the term, all words of a sentence an alias; and the seed.
_ENTRIES_SQL = f"""(SELECT array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS term, ['item ' || item_id] AS aliases, text AS definition, CAST(item_id % 6 AS INTEGER) AS importance FROM benchmark
    UNION ALL SELECT * FROM (VALUES {", ".join(f"('{t}', CAST([{', '.join(repr(x) for x in a)}] AS VARCHAR[]), '{d}', {i})" for t, a, d, i in glossary.SEED)}) AS s(term, aliases, definition, importance))"""
_NORMAL_SQL = "regexp_replace({0}, '\\s+', ' ', 'g')".format("replace(" * len(glossary.REPLACED) + "lower(trim({0}))" + "".join(f", '{a}', '{b}')" for a, b in glossary.REPLACED))
_NAMES_CTE = f"""e AS (SELECT * FROM {_ENTRIES_SQL} WHERE trim(term) <> '' AND trim(definition) <> ''),
    n AS (SELECT term, definition, coalesce(importance, 3) AS importance, {_NORMAL_SQL.format('term')} AS name, 99.0 AS exact FROM e UNION ALL SELECT term, definition, coalesce(importance, 3), {_NORMAL_SQL.format('alias')}, 100.0 FROM (SELECT *, unnest(aliases) AS alias FROM e)),
    named AS (SELECT * FROM n WHERE name <> '')"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    seed = spark.createDataFrame(glossary.SEED, "term string, aliases array<string>, definition string, importance int")
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    rows = table(spark, folder, "benchmark").select(words.alias("term"), F.array(F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("aliases"), F.col("text").alias("definition"), (F.col("item_id") % 6).cast("int").alias("importance"))
    return rows.unionByName(seed)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and benchmark items as questions for the glossary."""
    said = questions(spark, folder).select(F.struct("conv_id", "turn").alias("query_id"), "query")
    named = F.concat(F.lit("define "), F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    return said.unionByName(table(spark, folder, "benchmark").select(F.struct((-1 - F.col("item_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn")).alias("query_id"), named.alias("query")))


_ASKED_CTE = f"q AS (SELECT conv_id, turn, {_NORMAL_SQL.format('query')} AS q FROM ({QUESTIONS_SQL} UNION ALL SELECT -1 - item_id, 0, 'define ' || array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') FROM benchmark) WHERE {_NORMAL_SQL.format('query')} <> '')"


@query(f"""WITH {_NAMES_CTE}, {_ASKED_CTE},
    s AS (SELECT conv_id, turn, term, CASE WHEN q = name THEN exact WHEN contains(q, name) OR contains(name, q) THEN 82.0 + (importance - 3) * 2 END AS score, max(CASE WHEN q = name THEN exact END) OVER (PARTITION BY conv_id, turn) AS best FROM q, named),
    m AS (SELECT conv_id, turn, term, max(score) AS score FROM s WHERE score IS NOT NULL AND (best IS NULL OR score = best) GROUP BY ALL)
    SELECT conv_id, turn, term, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, term) AS INTEGER) AS rank FROM m QUALIFY rank <= 5""")
def glossary_exact_substring(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms by name and by part of a name, for all messages and benchmark items."""
    return glossary.search(_entries(spark, folder), _asked(spark, folder), fuzzy=False).select("query_id.*", "term", "score", "rank")


@query()
def glossary_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms by likeness as well: every benchmark item's term with a letter dropped and one doubled."""
    term = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    wrong = F.concat(F.substring(term, 1, 3), F.substr(term, F.lit(5)), F.substr(term, F.length(term)))
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), wrong.alias("query"))
    return glossary.search(_entries(spark, folder), asked)


@query(f"WITH {_NAMES_CTE} SELECT term, CAST(count(*) AS BIGINT) AS n_names FROM named GROUP BY term")
def glossary_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names under which each term is found."""
    return glossary.names(_entries(spark, folder)).groupBy("term").agg(F.count(F.lit(1)).alias("n_names"))


@query(f"""SELECT conv_id, turn, CASE WHEN d THEN 'FACTS|ISSUES|RULING' WHEN f AND NOT i AND NOT r THEN 'FACTS' WHEN r AND NOT f AND NOT i THEN 'RULING' WHEN i AND NOT f AND NOT r THEN 'ISSUES' ELSE 'FACTS|ISSUES|RULING' END AS sections
    FROM (SELECT conv_id, turn, contains(lower(query), 'fact') AS f, contains(lower(query), 'issue') AS i, contains(lower(query), 'ruling') OR contains(lower(query), 'decision') AS r, contains(lower(query), 'digest') OR contains(lower(query), 'covering') AS d FROM ({QUESTIONS_SQL}))""")
def template_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of the simplified template by question."""
    return questions(spark, folder).select("conv_id", "turn", display.template_sections(F.col("query")).alias("sections"))


#: What a classifier says of each message: an action with or without a focus, or none.
_SAID_SQL = "CASE turn % 4 WHEN 0 THEN concat('[SEARCH_CASES:', role, '] ', text) WHEN 1 THEN concat(text, ' [CASE_DIGEST]') WHEN 2 THEN concat('[WEB_SEARCH] ', text) ELSE text END"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SEARCH_CASES' WHEN 1 THEN 'CASE_DIGEST' WHEN 2 THEN 'WEB_SEARCH' END AS name, CASE turn % 4 WHEN 0 THEN role END AS focus FROM conversations")
def classifier_action(spark: SparkSession, folder: str) -> DataFrame:
    """Actions that a classifier's answers ask for."""
    said = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_SAID_SQL).alias("answer"))
    return said.select("conv_id", "turn", display.action(F.col("answer")).alias("a")).select("conv_id", "turn", "a.name", "a.focus")


@query("SELECT md5(doc_id || '|' || lang) AS key, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cached ' || doc_id ELSE 'made ' || doc_id END AS context FROM documents")
def context_cache_join(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts from the cache where it has them, else made anew."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    key = F.md5(F.encode(F.concat_ws("|", F.col("doc_id").cast("string"), "lang"), "utf-8"))
    keyed = docs.select(key.alias("key"), "doc_id")
    cache = keyed.where("doc_id % 2 = 0").select("key", F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("kept"))
    return keyed.join(cache, "key", "left").select("key", "doc_id", text.first_present(F.col("kept"), F.concat(F.lit("made "), F.col("doc_id").cast("string"))).alias("context"))


@query(f"""WITH {_NAMES_CTE}, q AS (SELECT item_id, definition, term, CASE item_id % 4 WHEN 0 THEN 'What is ' || term || '?' WHEN 1 THEN 'define item ' || item_id WHEN 2 THEN 'what is G.R. No. ' || item_id ELSE text END AS query FROM (SELECT *, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS term, text AS definition FROM benchmark))
    SELECT item_id AS query_id, CASE WHEN item_id % 4 IN (0, 1) THEN term || ': ' || definition END AS answer FROM q""")
def glossary_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that the glossary answers, and those that it leaves to a search."""
    item, term = F.col("item_id").cast("string"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    query_ = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("What is "), term, F.lit("?"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("define item "), item)).when(F.col("item_id") % 4 == 2, F.concat(F.lit("what is G.R. No. "), item)).otherwise(F.col("text"))
    return glossary.respond(_entries(spark, folder), table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), query_.alias("query")))


@query(CTE + """ SELECT doc_id, CASE WHEN contains(case_title, 'NLRC') THEN 'Standards|Relations' WHEN contains(case_title, 'PEOPLE') THEN 'Felonies' ELSE 'Not specified' END AS areas FROM cases""")
def syllabus_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of the subject of every case."""
    topics = spark.createDataFrame([("labor_law", ["Standards", "Relations"]), ("criminal_law", ["Felonies"])], "subject string, areas array<string>")
    subject = F.when(F.contains("case_title", F.lit("NLRC")), "labor_law").when(F.contains("case_title", F.lit("PEOPLE")), "criminal_law").otherwise("civil_law")
    found = glossary.syllabus(cases(spark, folder).select("doc_id", subject.alias("subject")), topics)
    return found.select("doc_id", F.array_join("areas", "|").alias("areas"))
