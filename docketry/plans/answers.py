"""Queries that make answers: requests, history, lists of decisions, results from the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import display, titles
from docketry.operators.running import running
from docketry.operators import search
from docketry.plans.cases import CTE
from docketry.plans.registry import query
from docketry.sources.tables import cases, table


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN false WHEN role NOT IN ('system', 'user', 'assistant') THEN false WHEN turn % 7 = 3 THEN false ELSE true END AS valid, CASE WHEN turn % 5 = 4 THEN '' ELSE trim(role) END AS query, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_history,
    CASE WHEN turn % 7 = 3 THEN 'long' WHEN turn % 3 = 1 THEN 'simplified' ELSE 'full' END AS template_mode FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 4 = 1 THEN 'robot' ELSE role END AS role FROM conversations)""")
def request_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Chat requests as JSON: which are valid, and what holds where they leave something out."""
    turn = F.col("turn")
    role = F.when((turn % 2 == 0) & (F.col("conv_id") % 4 == 1), "robot").otherwise(F.col("role"))
    asked = F.when(turn % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), role))
    history = F.when(turn % 2 == 0, F.array(F.struct(role.alias("role"), F.lit("hello").alias("content"))))
    body = F.to_json(F.struct(asked.alias("query"), history.alias("history"), F.when(turn % 7 == 3, "long").when(turn % 3 == 1, "simplified").alias("template_mode")))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", display.request(body).alias("r"), role.alias("role"))
    known = F.col("role").isin("system", "user", "assistant")
    return rows.select("conv_id", "turn", (F.col("r.valid") & known).alias("valid"), "r.query", "r.n_history", "r.template_mode")


@query("""WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'G.R. No. ' || (100000 + conv_id) || '-' || turn WHEN 2 THEN 'Party ' || conv_id || ' vs Party ' || turn END AS named, turn % 4 = 1 AS numbered FROM conversations)
    SELECT conv_id, CAST(max(turn) AS BIGINT) AS turn, arg_max(CASE WHEN numbered THEN substr(named, 10) END, CASE WHEN numbered THEN turn ELSE turn END) FILTER (numbered AND turn = last) AS gr_number, arg_max(named, turn) FILTER (NOT numbered AND turn = last) AS case_title
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM m WHERE named IS NOT NULL) GROUP BY conv_id""")
def history_last_case(spark: SparkSession, folder: str) -> DataFrame:
    """The case that the latest message of each conversation that names one is about."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    named = F.when(turn % 4 == 1, F.concat(F.lit("As held in G.R. No. "), (F.col("conv_id") + 100000).cast("string"), F.lit("-"), turn.cast("string"), F.lit(" it is so."))).when(turn % 4 == 2, F.concat(F.lit("See **Party "), conv, F.lit(" vs Party "), turn.cast("string"), F.lit("**."))).when(turn % 4 == 3, "**vs**")
    found = table(spark, folder, "conversations").select("conv_id", "turn", display.case_in(F.coalesce(named, F.col("role"))).alias("c")).where("c is not null")
    return found.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("c", "turn").alias("c")).select("conv_id", "turn", "c.*")


@query("""WITH t AS (SELECT source, count(*) AS n, sum(length(text)) AS size FROM documents GROUP BY source), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
    SELECT source, CAST(any_value(n) AS BIGINT) AS n_all, any_value(size > 100000 AND n > 20) AS truncated, CAST(count(*) AS BIGINT) AS n_shown, CAST(sum(doc_id) AS BIGINT) AS ids FROM r JOIN t USING (source) WHERE NOT (size > 100000 AND n > 20) OR place <= 20 GROUP BY source""")
def response_truncation(spark: SparkSession, folder: str) -> DataFrame:
    """Debug lists of answers: of one beyond 100 kB the first twenty entries stay."""
    docs = table(spark, folder, "documents").select("source", "doc_id", F.length("text").alias("size"))
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_all"), F.sum("size").alias("size"))
    told = sums.select("source", "n_all", display.debug_shown(F.col("size"), F.col("n_all")).alias("d")).select("source", "n_all", "d.truncated")
    first = docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("place") <= display.DEBUG_KEPT)
    cut = first.join(told.where("truncated"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_shown"), F.sum("doc_id").alias("ids"))
    whole = docs.join(told.where("not truncated"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_shown"), F.sum("doc_id").alias("ids"))
    return told.join(cut.unionByName(whole), "source").select("source", "n_all", "truncated", "n_shown", "ids")


def _results(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """Results of searches: pages in batches of ten ids, the first ``most`` of each."""
    rows = table(spark, folder, "pages").select(F.floor(F.col("page_id") / 10).alias("batch"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("page_id"))).where(F.col("place") <= most)


_RANKED = "(SELECT CAST(page_id // 10 AS BIGINT) AS batch, page_id, coalesce(url, '') AS url, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS place FROM pages)"


def _in_order(line: F.Column) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])


@query(f"SELECT batch, string_agg(chr(10) || place || '. **Page ' || page_id || '**' || chr(10) || '   Source: ' || substr(url, 9, 4) || chr(10) || '   Content: about ' || page_id || chr(10) || '   URL: ' || url || chr(10), '' ORDER BY place) AS context FROM {_RANKED} WHERE place <= 5 GROUP BY batch")
def web_context(spark: SparkSession, folder: str) -> DataFrame:
    """The first five results of every search as context for a model."""
    page = F.col("page_id").cast("string")
    item = display.web_item(F.col("place"), F.concat(F.lit("Page "), page), F.substring("url", 9, 4), F.concat(F.lit("about "), page), F.col("url"))
    return _results(spark, folder, 5).groupBy("batch").agg(F.array_join(_in_order(item), "").alias("context"))


@query(f"SELECT batch, string_agg(place || '. ' || url, chr(10) ORDER BY place) AS answer FROM {_RANKED} WHERE place <= 3 GROUP BY batch")
def web_answer(spark: SparkSession, folder: str) -> DataFrame:
    """First three results of every search as a list, by their place among all its pages."""
    return _results(spark, folder, 3).groupBy("batch").agg(F.array_join(_in_order(F.concat(F.col("place").cast("string"), F.lit(". "), F.col("url"))), "\n").alias("answer"))


@query(f"SELECT batch, 'Based on current web sources, here''s what I found:' || chr(10) || chr(10) || string_agg('**' || place || '. Page ' || page_id || '**' || chr(10) || 'Summary: ' || url || chr(10), chr(10) ORDER BY place) AS answer FROM {_RANKED} WHERE place <= 3 GROUP BY batch")
def web_plain_answer(spark: SparkSession, folder: str) -> DataFrame:
    """An answer from the first three results without a model."""
    lists = _results(spark, folder, 5).groupBy("batch").agg(_in_order(F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("t"), _in_order(F.col("url")).alias("s"))
    return lists.select("batch", display.web_plain(F.col("t"), F.col("s")).alias("answer"))


@query("""SELECT CAST(item_id AS BIGINT) AS item_id, CASE WHEN item_id % 5 = 0 THEN 'Web search is currently unavailable. Please try searching for specific cases in our database or rephrase your question.' WHEN item_id % 5 = 1 THEN 'Web search is not configured. Please check API credentials or try searching for specific cases in our database.'
    WHEN item_id % 5 = 2 THEN 'I encountered an error while searching for current information. Please try again later or ask about specific cases in our database.' WHEN item_id % 5 = 3 THEN 'I couldn''t find current information on that topic. Please try rephrasing your question or asking about specific cases in our database.' END AS message FROM benchmark""")
def web_states(spark: SparkSession, folder: str) -> DataFrame:
    """What is said where a search of the web gives nothing."""
    k = F.col("item_id") % 5
    return table(spark, folder, "benchmark").select("item_id", display.web_state(k != 0, k != 1, k == 2, F.when(k == 3, 0).otherwise(4)).alias("message"))


@query(CTE + """, r AS (SELECT *, row_number() OVER (PARTITION BY ponente ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY ponente) AS total FROM cases WHERE ponente IS NOT NULL),
    i AS (SELECT ponente, place, total, '**' || place || '. ' || case_title || coalesce(' | ' || promulgation_year, '') || '**' || coalesce(chr(10) || '- ' || gr_number, '') || chr(10) || '- Ponente: ' || ponente || chr(10) || '- Type: Civil' AS item FROM r WHERE place <= 5)
    SELECT ponente, '## Cases Penned by Justice ' || ponente || chr(10) || chr(10) || string_agg(item || chr(10), chr(10) ORDER BY place) || chr(10) || CASE WHEN any_value(total) > count(*) THEN '*Note: Showing ' || count(*) || ' of ' || any_value(total) || ' cases found.*' ELSE '*Found ' || any_value(total) || CASE WHEN any_value(total) = 1 THEN ' case' ELSE ' cases' END || '.*' END
      || chr(10) || chr(10) || chr(128161) || ' **Tip:** You can ask for more details about any specific case by mentioning its name or G.R. number.' AS answer FROM i GROUP BY ponente""")
def justice_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The first five decisions of every justice as an answer, with how many there are."""
    own = cases(spark, folder).where("ponente is not null")
    totals = own.groupBy("ponente").agg(F.count(F.lit(1)).alias("total"))
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("ponente").orderBy("doc_id"))).where("place <= 5")
    item = display.listed_case(F.col("place"), F.col("case_title"), F.col("promulgation_year").cast("string"), F.col("gr_number"), F.col("ponente"), F.lit("civil"))
    return first.groupBy("ponente").agg(_in_order(item).alias("items")).join(totals, "ponente").select("ponente", display.justice_answer(F.col("ponente"), F.col("items"), F.col("total")).alias("answer"))


@query("""WITH c AS (SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'summary' WHEN 1 THEN 'ruling' WHEN 2 THEN 'facts' WHEN 3 THEN 'issues' WHEN 4 THEN 'arguments' WHEN 5 THEN 'body' ELSE 'odd' END AS section, least(doc_id % 7, 5) AS priority, greatest(1, length(text) // 40) AS tokens, doc_id % 13 AS score FROM documents),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY priority, score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c)
    SELECT source, string_agg('[' || upper(substr(section, 1, 1)) || substr(section, 2) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' (No. ' || doc_id || ')' END || '] about ' || doc_id, chr(10) || chr(10) ORDER BY priority, score DESC, doc_id) AS context FROM r WHERE running <= 2500 GROUP BY source""")
def packed_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context for a model from each source's chunks, by section and score within the budget."""
    sections = F.array(*map(F.lit, ["summary", "ruling", "facts", "issues", "arguments", "body", "odd"]))
    item = F.col("doc_id").cast("string")
    number = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("No. "), item))
    rows = table(spark, folder, "documents").select("source", "doc_id", F.element_at(sections, (F.col("doc_id") % 7 + 1).cast("int")).alias("section"), F.concat(F.lit("about "), item).alias("content"), F.greatest(F.lit(1), F.floor(F.length("text") / 40)).alias("token_count"), (F.col("doc_id") % 13).alias("score"), number.alias("gr_number"), F.lit(None).cast("string").alias("special_number"))
    return search.packed_context(rows, "source", key="doc_id")[1]


@query(r"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'plain:see |case:G.R. No. ' || conv_id || '>' || conv_id || '|plain: and |bold:' || role WHEN 1 THEN 'link:site>https://h/' || turn || '|plain:, |link:x>y' ELSE 'plain:' || role || ' says' END AS parts FROM conversations""")
def richtext_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Links, bold words and plain text of answers, in order."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see **[G.R. No. "), conv, F.lit("](gr:"), conv, F.lit(")** and **"), "role", F.lit("**"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("**[site](https://h/"), turn, F.lit(")**, [x](y)"))).otherwise(F.concat("role", F.lit(" says")))
    told = lambda s: F.concat(s["kind"], F.lit(":"), s["text"], F.coalesce(F.concat(F.lit(">"), s["target"]), F.lit("")))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(F.transform(display.spans(said), told), "|").alias("parts"))


@query("""SELECT conv_id, turn, 'heading:Facts|paragraph:' || role || '+said|list:one+two|heading:' || turn || CASE WHEN turn % 2 = 0 THEN '|paragraph:- a+b' ELSE '' END AS blocks FROM conversations""")
def richtext_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, lists and paragraphs of answers, in order."""
    said = F.concat(F.lit("## Facts\n"), "role", F.lit("\nsaid\n\n- one\n* two\n**"), F.col("turn").cast("string"), F.lit("**:"), F.when(F.col("turn") % 2 == 0, "\n- a\nb").otherwise("\n"))
    told = lambda b: F.concat(b["kind"], F.lit(":"), F.array_join(b["lines"], "+"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(F.transform(display.blocks(said), told), "|").alias("blocks"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(trim(substr(text, 1, 40))) > 20 THEN trim(substr(text, 1, 40)) ELSE 'plain ' || doc_id END AS summary FROM documents")
def listing_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries for a list of cases: a model's where it says enough, else the plain one."""
    made = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).when(F.col("doc_id") % 3 == 1, "  too short  ")
    return table(spark, folder, "documents").select("doc_id", display.listing_summary(made, F.concat(F.lit("plain "), F.col("doc_id").cast("string"))).alias("summary"))


@query("SELECT conv_id, turn, 'System: be brief' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Context: c' || turn || chr(10) || chr(10) ELSE '' END || 'User: ' || text AS prompt FROM conversations")
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a model is asked with each message."""
    context = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("turn").cast("string"))).when(F.col("turn") % 3 == 0, "")
    return table(spark, folder, "conversations").select("conv_id", "turn", display.prompt(F.col("text"), context, "be brief").alias("prompt"))


@query("""WITH c AS (SELECT conv_id, turn, text, conv_id % 7 AS case_no FROM conversations)
    SELECT conv_id, turn, 'G.R. No. ' || case_no AS case_id, CAST(count(*) OVER w AS BIGINT) AS n_before, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_before FROM c WINDOW w AS (PARTITION BY case_no ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)""")
def history_by_case(spark: SparkSession, folder: str) -> DataFrame:
    """How the history of each case that messages name grows, in the order of arrival."""
    rows = table(spark, folder, "conversations")
    message = F.concat(F.lit("on G.R. No. "), (F.col("conv_id") % 7).cast("string"), F.lit(": "), "text")
    named = rows.select("conv_id", "turn", F.concat(F.lit("G.R. No. "), display.case_in(message)["gr_number"]).alias("case_id"), F.lit(1).alias("one"), F.length("text").alias("chars"))
    return running(named, "case_id", [F.asc("conv_id"), F.asc("turn")], {"n_before": "one", "chars_before": "chars"}).drop("one", "chars")


@query(CTE + " SELECT title, min(doc_id) AS doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN case_title WHEN doc_id % 6 = 4 THEN 'Case (' || coalesce(gr_number, special_number) || ')' ELSE case_title || ', RESPONDENT.' END AS title FROM cases) GROUP BY title")
def unique_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Of the cases that are shown under one title the first; a missing title is read from the text."""
    title = F.when(F.col("doc_id") % 9 != 0, F.col("case_title"))
    own = cases(spark, folder).select("doc_id", titles.shown(title, F.col("clean_text"), F.col("gr_number"), F.col("special_number")).alias("title"))
    return search.first_per_key(own, F.col("title"), F.asc("doc_id")).select("title", "doc_id")
