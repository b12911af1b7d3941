"""Questions end to end: routed, looked up or searched, rescored, each case once, with a summary.

All questions of a table are answered by one plan. Tables of questions go to
every executor as far as ``search.sized`` finds them small; cases are shuffled
only where a search needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import extract, titles
from docketry.operators import search
from docketry.operators.substrings import containing
from docketry.sources import scratch

TOP = 5
#: Forms under which a number may be stored, the first that any case has counts.
FORMS = ["", "G.R. No. ", "GR No. "]


def route(queries: DataFrame) -> DataFrame:
    """``queries`` with what they ask for: a justice, a special or an ordinary number, parties, or words."""
    q = F.col("query")
    routed = queries.select("query_id", "query", extract.special_of_query(q).alias("special"), extract.ponente_of_query(q).alias("justice"), extract.parties(q).alias("parties"))
    routed = routed.withColumn("gr", F.when(F.col("special").isNull(), extract.gr_of_query(q)))
    kind = F.when(extract.asks_ponente(q) & F.col("justice").isNotNull(), "ponente").when(F.col("special").isNotNull(), "special").when(F.col("gr").isNotNull(), "number")
    return routed.withColumn("route", kind.when(extract.asks_title(q) & (F.size("parties") >= 2), "title").otherwise("words"))


def _routed(queries: DataFrame) -> DataFrame:
    """``route``, written once: every way of answering reads it, and its patterns are costly on long questions."""
    return scratch.table(route(queries), "routed")


def _fields(key: str) -> list[str]:
    return [key, "case_title", "gr_number", "special_number", "ponente", "clean_text"]


def of_justices(own: DataFrame, asked: DataFrame, key: str, top: int) -> DataFrame:
    """The first ``top`` cases of the justice that each question (query_id, route, justice) names, each number once.

    A decision's justice is the one asked for if the name holds the surname
    (``extract.ponente_matches``). So distinct surnames are looked up in
    distinct names by a run of characters; cases and questions meet by equality,
    and questions on one justice share the cases found.
    """
    surname = F.element_at(F.split(extract.plain_name(F.col("justice")), " "), -1)
    names = own.where(F.col("ponente").isNotNull()).select(F.col("ponente").alias("large_id"), extract.plain_name(F.col("ponente")).alias("text")).distinct()
    met = containing(names, asked.where(F.col("justice").isNotNull()).select(F.col("justice").alias("small_id"), surname.alias("part")).distinct())
    penned = own.join(search.sized(met.select(F.col("large_id").alias("ponente"), F.col("small_id").alias("justice"))), "ponente").withColumn("number", _number())
    once = penned.withColumn("_n", F.row_number().over(Window.partitionBy("justice", "number").orderBy(key))).where("_n = 1")
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy("justice").orderBy(key))).where(F.col("_n") <= top)
    return asked.select("query_id", "route", "justice").join(search.sized(first.select("justice", *_fields(key))), "justice").select("query_id", "route", F.lit(0.0).alias("score"), *_fields(key))


def looked_up(own: DataFrame, asked: DataFrame, key: str, top: int) -> DataFrame:
    """(query_id, route, score, fields of cases) of routed questions on a number, a special number or a justice."""
    fields = _fields(key)
    numbered = asked.where("route in ('number', 'special')").select("query_id", "route", F.explode(F.when(F.col("route") == "special", F.array(F.struct(F.lit(0).alias("place"), F.col("special").alias("number")))).otherwise(F.array(*(F.struct(F.lit(n).alias("place"), F.concat(F.lit(p), F.col("gr")).alias("number")) for n, p in enumerate(FORMS))))).alias("form"))
    numbers = own.select("*", F.explode(F.array_distinct(F.array_compact(F.array("gr_number", "special_number")))).alias("number"))
    exact = numbers.join(search.sized(numbered.select("query_id", "route", "form.place", "form.number")), "number")
    exact = exact.withColumn("first", F.min("place").over(Window.partitionBy("query_id"))).where("place = first").select("query_id", "route", F.lit(0.0).alias("score"), *fields)
    return exact.unionByName(of_justices(own, asked.where("route = 'ponente'"), key, top))


def _number() -> Column:
    return extract.case_key(F.col("gr_number"), F.col("special_number"), F.col("case_title"))


def _shown(found: DataFrame, key: str, top: int) -> DataFrame:
    """The best ``top`` cases of every question, each number once, as they are displayed."""
    order = [F.desc(F.round("score", 9)), F.asc(key)]
    once = found.withColumn("number", _number()).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "number").orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top)
    title = titles.shown(F.col("case_title"), F.col("clean_text"), F.col("gr_number"), F.col("special_number"))
    return ranked.select("query_id", "route", "rank", key, title.alias("title"), "number", extract.number_link(F.col("number")).alias("link"), extract.dispositive_excerpt(F.col("clean_text")).alias("summary"))


def look_up(cases: DataFrame, queries: DataFrame, key: str = "doc_id", top: int = TOP) -> DataFrame:
    """(query_id, route, rank, key, title, number, link, summary) for the questions on numbers and justices alone; no text is searched."""
    return _shown(looked_up(cases.select(*_fields(key)), _routed(queries), key, top), key, top)


def answer(cases: DataFrame, queries: DataFrame, key: str = "doc_id", top: int = TOP) -> DataFrame:
    """(query_id, route, rank, key, title, number, link, summary): up to ``top`` cases for every question.

    A title question that no title meets is searched by its words.
    """
    asked, fields = _routed(queries), _fields(key)
    own = cases.select(*fields)
    named = search.named_in_titles(own, asked.where("route = 'title'"), key).select("query_id", F.col(key).alias("_named"))
    titled = own.join(named, F.col(key) == F.col("_named")).select("query_id", F.lit("title").alias("route"), F.lit(0.0).alias("score"), *fields)

    met = titled.select("query_id").distinct()
    worded = asked.where("route in ('words', 'title')").join(met, "query_id", "left_anti")
    hits = search.ranked(search.bm25(own, worded.select("query_id", "query"), key, "clean_text", first=4 * top), "doc_id", 4 * top).withColumnRenamed("doc_id", "_hit").withColumnRenamed("score", "_bm25")
    found = own.join(hits, F.col(key) == F.col("_hit")).join(worded.select("query_id", "query"), "query_id")
    similar = extract.title_similarity(extract.query_parts(F.col("query")), F.col("case_title"))
    searched = found.select("query_id", F.lit("words").alias("route"), (similar * 0.7 + F.col("_bm25") * 0.3).alias("score"), *fields)
    return _shown(looked_up(own, asked, key, top).unionByName(titled).unionByName(searched), key, top)
