"""Queries of retrieval: search, routing, rescoring, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import extract, text
from docketry.operators import engine, index, search
from docketry.plans.cases import CHUNKS_SQL, CTE, SUMMARY_CTE, all_chunks
from docketry.plans.registry import query
from docketry.sources import scratch
from docketry.sources.tables import QUESTIONS_SQL, cases, questions, spread, table

QUESTION = "the of and erthat tion nothere"
TOKENS = r"list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"



def _bm25_cte(texts: str, question: str) -> str:
    """Scores of the texts (doc_id, text) for a question, and their ranks."""
    return f"""
    p AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM {texts}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
    tot AS (SELECT (SELECT count(*) FROM {texts}) AS n, sum(dl) AS total FROM dl),
    idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, tot GROUP BY term, n),
    q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TOKENS.format(f"'{question}'")}) AS term) GROUP BY ALL),
    w AS (SELECT term, qtf, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM q JOIN idf USING (term)),
    sc AS (SELECT doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS score FROM tf JOIN w USING (term) JOIN dl USING (doc_id), tot GROUP BY doc_id),
    lex AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


BM25_CTE = _bm25_cte("documents", QUESTION)
VECTOR_CTE = """
    vq AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0),
    vs AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q) AS score FROM embeddings, vq),
    vec AS (SELECT vec_id AS doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs)"""
RRF_CTE = f"WITH {BM25_CTE}, {VECTOR_CTE}, both_lists AS (SELECT doc_id, rank, 0 AS list FROM vec WHERE rank <= 50 UNION ALL SELECT doc_id, rank, 1 FROM lex WHERE rank <= 50), rrf AS (SELECT doc_id, sum(1.0 / CAST(rank + 60 AS DOUBLE)) AS rrf, min(list * 1000000 + rank) AS first_rank FROM both_lists GROUP BY doc_id)"


def _question(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("query_id"), F.lit(QUESTION).alias("query"))


def _lexical(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return search.ranked(search.bm25(spread(table(spark, folder, "documents")), _question(spark), first=k), "doc_id", k)


def _vector(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("q"))
    return search.ranked(search.vector_scores(vectors, asked), "vec_id", k)


@query(f"WITH {BM25_CTE} SELECT doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lex WHERE rank <= 10")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best documents by BM25."""
    return _lexical(spark, folder, 10).select("doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_CTE} SELECT doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lex WHERE rank <= 10")
def stored_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best documents by a word index that is written first; a question reads its terms' folders and opens promising blocks alone."""
    path = scratch.path(spark, "index")
    index.build(spread(table(spark, folder, "documents")), path)
    return index.best(spark, path, _question(spark), 10).select("doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {VECTOR_CTE} SELECT doc_id AS vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM vec WHERE rank <= 20")
def stored_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty nearest of unit vectors stored by cells."""
    path = scratch.path(spark, "index")
    vectors = table(spark, folder, "embeddings")
    index.build_vectors(vectors, path)
    asked = vectors.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("q"))
    return index.nearest(spark, path, asked, 20).select(F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_CTE} SELECT CAST(count(*) AS BIGINT) AS n_documents, round(sum(coalesce(score, 0)), 4) AS total, CAST(count(*) FILTER (score IS NULL) AS BIGINT) AS n_zero FROM documents LEFT JOIN sc USING (doc_id)")
def bm25_all_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, those without a shared term as zero."""
    docs = spread(table(spark, folder, "documents"))
    scored = docs.select("doc_id").join(search.bm25(docs, _question(spark)), "doc_id", "left")
    return scored.agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 4).alias("total"), F.count_if(F.col("score").isNull()).alias("n_zero"))


@query(f"WITH {VECTOR_CTE} SELECT doc_id AS vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM vec WHERE rank <= 20")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty nearest vectors by cosine."""
    return _vector(spark, folder, 20).select("vec_id", "rank", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    vec = _vector(spark, folder, 50).select("query_id", F.col("vec_id").alias("id"), "rank")
    lex = _lexical(spark, folder, 50).select("query_id", F.col("doc_id").alias("id"), "rank")
    return search.fuse(vec, lex)


@query(RRF_CTE + " SELECT doc_id, round(rrf, 9) AS rrf, CAST(row_number() OVER (ORDER BY rrf DESC, first_rank) AS INTEGER) AS place FROM rrf QUALIFY place <= 15")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen best by both lists."""
    fused = _fused(spark, folder).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first_rank")))
    return fused.where("place <= 15").select(F.col("id").alias("doc_id"), F.round("rrf", 9).alias("rrf"), "place")


@query(f"WITH {VECTOR_CTE} SELECT doc_id, round(1.0 / (rank + 60), 9) AS rrf, CAST(rank AS INTEGER) AS place FROM vec WHERE rank <= 15")
def rrf_one_list(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion where the words of a question meet nothing: the other list in its order."""
    vec = _vector(spark, folder, 50).select("query_id", F.col("vec_id").alias("id"), "rank")
    unmet = spark.range(1).select(F.lit(1).alias("query_id"), F.lit("zzzzqqqq").alias("query"))
    lex = search.ranked(search.bm25(spread(table(spark, folder, "documents")), unmet, first=50), "doc_id", 50).select("query_id", F.col("doc_id").alias("id"), "rank")
    placed = search.fuse(vec, lex).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first_rank")))
    return placed.where("place <= 15").select(F.col("id").alias("doc_id"), F.round("rrf", 9).alias("rrf"), "place")


@query(RRF_CTE + ", top AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY rrf DESC, first_rank) AS INTEGER) AS place FROM rrf QUALIFY place <= 15) SELECT doc_id, place, lang, source, n_chars FROM top JOIN documents USING (doc_id)")
def hybrid_hydrated(spark: SparkSession, folder: str) -> DataFrame:
    """Fused results with the fields of their documents; ids without a document are dropped."""
    top = rrf_fusion(spark, folder).select("doc_id", "place")
    return F.broadcast(top).join(table(spark, folder, "documents"), "doc_id").select("doc_id", "place", "lang", "source", "n_chars")


@query(CTE + rf""", s AS (SELECT conv_id, turn, list_transform(list_slice(regexp_split_to_array(lower(query), '\bvs\b\.?|\bversus\b'), 1, 2), lambda p: regexp_replace(p, '^[\s\x0b\x{{85}}\pZ]+|[\s\x0b\x{{85}}\pZ]+$', '', 'g')) AS sides FROM ({QUESTIONS_SQL})),
    q AS (SELECT conv_id, turn, sides[1] AS a, sides[2] AS b FROM s WHERE len(sides) = 2 AND sides[1] <> '' AND sides[2] <> ''),
    m AS (SELECT conv_id, turn, doc_id, case_title, row_number() OVER (PARTITION BY conv_id, turn ORDER BY doc_id) AS n FROM q JOIN cases ON contains(lower(case_title), a) AND contains(lower(case_title), b)) SELECT conv_id, turn, doc_id, case_title FROM m WHERE n <= 50""")
def title_party_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty cases whose title names both parties, for all questions of messages that name two."""
    asked = questions(spark, folder).select(F.struct("conv_id", "turn").alias("query_id"), extract.parties(F.col("query")).alias("parties"))
    return search.named_in_titles(cases(spark, folder).select("doc_id", "case_title"), asked, first=50).select("query_id.*", "doc_id", "case_title")


@query(CTE + " SELECT doc_id, gr_number FROM cases WHERE gr_number IN ('100010', 'G.R. No. 100010', 'GR No. 100010') ORDER BY doc_id LIMIT 8")
def exact_number_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with a number; the first of its forms that any case has counts."""
    forms = ["100010", "G.R. No. 100010", "GR No. 100010"]
    place = F.array_position(F.array(*map(F.lit, forms)), F.col("gr_number"))
    met = cases(spark, folder).where(F.col("gr_number").isin(forms)).withColumn("form", place)
    return met.join(F.broadcast(met.agg(F.min("form").alias("form"))), "form").orderBy("doc_id").limit(8).select("doc_id", "gr_number")


#: Questions that are answered end to end.
ASKED = ["cases penned by justice Peralta", "Acme vs NLRC", "G.R. No. 0176692 digest", "A.M. No. P-11-2907 ruling", "what is amparo", "GR No. 123456", "justice Lazaro-Javier decisions", "annulment cases 150001"]


@query(rf"""SELECT conv_id, turn, regexp_matches(lower(trim(query)), '{extract.PONENTE_QUERY}') AS is_ponente,
      regexp_matches(lower(query), '\bvs\.?\b|\bversus\b') AS is_title,
      CASE WHEN regexp_matches(query, '(?i)A\.M\.\s+No') THEN 'A.M. No. ' || regexp_extract(query, '(?i)A\.M\.\s+No\.?\s*([A-Z0-9\-]+)', 1) END AS special_number,
      CASE WHEN NOT regexp_matches(query, '(?i)A\.M\.\s+No') THEN nullif(ltrim(coalesce(nullif(regexp_extract(query, '(?i)G\.?R\.?\s*NOS?\.?\s*([0-9\-]+)', 1), ''), regexp_extract(query, '\b(\d{{5,}})\b', 1)), '0'), '') END AS gr_number,
      CASE (conv_id + turn) % 12 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'Peralta' WHEN 1 THEN 'Lazaro-Javier' ELSE 'Gesmundo' END WHEN 6 THEN 'Lazaro-Javier' END AS justice
    FROM ({QUESTIONS_SQL})""")
def query_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Where the questions of all messages go: a justice's decisions, a title, a special or an ordinary number."""
    q = F.col("query")
    special = extract.special_of_query(q)
    return questions(spark, folder).select("conv_id", "turn", extract.asks_ponente(q).alias("is_ponente"), extract.asks_title(q).alias("is_title"), special.alias("special_number"), F.when(special.isNull(), extract.gr_of_query(q)).alias("gr_number"), extract.ponente_of_query(q).alias("justice"))


@query(CTE + " SELECT doc_id, ponente FROM cases WHERE contains(lower(ponente), 'lazaro')")
def ponente_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of the justice that a question names by surname."""
    name = extract.ponente_of_query(F.lit("cases penned by Justice Lazaro"))
    return cases(spark, folder).where(extract.ponente_matches(F.col("ponente"), name)).select("doc_id", "ponente")


TITLE_QUESTION = "Acme Corporation vs. NLRC 8"
SIMILAR_SQL = ", texts AS (SELECT doc_id, clean_text AS text FROM cases)," + _bm25_cte("texts", TITLE_QUESTION) + """, sim AS (SELECT *, CAST(ts AS DOUBLE) AS title_score FROM (SELECT doc_id, case_title, gr_number, special_number, CASE WHEN contains(l, 'acme corporation vs nlrc 8') THEN 100.0 ELSE 0.0 END + CASE WHEN contains(l, 'acme corporation') THEN 50.0 ELSE 0.0 END
      + CASE WHEN contains(l, 'nlrc 8') THEN 50.0 ELSE 0.0 END + 20.0 * len(list_filter(['acme', 'corporation', 'nlrc'], lambda p: contains(l, p))) AS ts, coalesce(round(100 * sc.score / (SELECT max(score) FROM sc), 9), 0) AS score FROM (SELECT *, lower(case_title) AS l FROM cases) LEFT JOIN sc USING (doc_id))),
    comb AS (SELECT *, CASE WHEN score > 50 THEN score + 0.1 * title_score ELSE 0.7 * title_score + 0.3 * score END AS combined FROM sim)"""


def _rescored(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with how well their titles meet a question, their BM25 score in percent of the best one's, and both in one."""
    rows, parts = cases(spark, folder), extract.query_parts(F.lit(TITLE_QUESTION))
    asked = spark.range(1).select(F.lit(1).alias("query_id"), F.lit(TITLE_QUESTION).alias("query"))
    found = search.bm25(rows.select("doc_id", F.col("clean_text").alias("text")), asked).select("doc_id", F.col("score").alias("bm25"))
    best = found.agg(F.max("bm25").alias("best"))
    scored = rows.withColumn("title_score", extract.title_similarity(parts, F.col("case_title"))).join(found, "doc_id", "left").crossJoin(F.broadcast(best))
    scored = scored.withColumn("score", F.coalesce(F.round(100 * F.col("bm25") / F.col("best"), 9), F.lit(0.0)))
    both = F.when(F.col("score") > 50, F.col("score") + 0.1 * F.col("title_score")).otherwise(0.7 * F.col("title_score") + 0.3 * F.col("score"))
    return scored.withColumn("combined", both)


@query(CTE + SIMILAR_SQL + " SELECT doc_id, title_score FROM sim")
def title_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """How well titles meet a question."""
    return cases(spark, folder).select("doc_id", extract.title_similarity(extract.query_parts(F.lit(TITLE_QUESTION)), F.col("case_title")).alias("title_score"))


@query(CTE + SIMILAR_SQL + " SELECT doc_id, round(combined, 6) AS combined FROM comb")
def combined_score(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval score and title score in one."""
    return _rescored(spark, folder).select("doc_id", F.round("combined", 6).alias("combined"))


@query(CTE + SIMILAR_SQL + """, u AS (SELECT *, row_number() OVER (PARTITION BY coalesce(gr_number, special_number, case_title) ORDER BY combined DESC, doc_id) AS n FROM comb)
    SELECT doc_id, round(combined, 6) AS combined FROM u WHERE n = 1 ORDER BY u.combined DESC, doc_id LIMIT 5""")
def picked_top5_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Five best cases, each once."""
    key = extract.case_key(F.col("gr_number"), F.col("special_number"), F.col("case_title"))
    return search.first_per_key(_rescored(spark, folder), key, F.desc("combined"), F.asc("doc_id"), limit=5).select("doc_id", F.round("combined", 6).alias("combined"))


@query("""WITH c AS (SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS priority, greatest(1, length(text) // 4) AS tokens, doc_id % 13 AS score FROM documents),
    r AS (SELECT doc_id, source, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY priority, score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c) SELECT doc_id, source, running FROM r WHERE running <= 2500""")
def context_budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by section and score until the token budget is spent, for each source."""
    names = F.element_at(F.array(*map(F.lit, ["summary", "ruling", "facts", "issues", "arguments", "body"])), (F.col("doc_id") % 6 + 1).cast("int"))
    order = F.array_position(F.array(*map(F.lit, ["summary", "ruling", "facts", "issues", "arguments", "body"])), F.col("section"))
    rows = table(spark, folder, "documents").select("doc_id", "source", names.alias("section"), text.token_estimate(F.col("text")).cast("long").alias("tokens"), (F.col("doc_id") % 13).alias("score"))
    return search.within_budget(rows, "tokens", 2500, order, F.desc("score"), F.asc("doc_id"), by="source").select("doc_id", "source", "running")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE coalesce(text, '') <> '') WHERE n <= 5")
def history_last5(spark: SparkSession, folder: str) -> DataFrame:
    """Last five messages of every conversation that say anything."""
    rows = table(spark, folder, "conversations").where(F.coalesce("text", F.lit("")) != "")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 5").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_before, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def history_growth(spark: SparkSession, folder: str) -> DataFrame:
    """How the history of a conversation grows with its turns."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "conversations").select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("n_before"), F.sum(F.length("text")).over(w).alias("chars_before"))


@query("""WITH v AS (SELECT doc_id, 1 AS variant FROM documents WHERE contains(text, 'zzzz') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(text, 'idiot') UNION ALL SELECT doc_id, 3 FROM documents WHERE lang = 'en'),
    f AS (SELECT doc_id, variant, rank() OVER (ORDER BY variant) AS r FROM v) SELECT doc_id, CAST(variant AS INTEGER) AS variant FROM f WHERE r = 1""")
def variant_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the first form of a question that has any."""
    docs = table(spark, folder, "documents")
    tries = [F.contains("text", F.lit("zzzz")), F.contains("text", F.lit("idiot")), F.col("lang") == "en"]
    both = docs.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(c, n + 1) for n, c in enumerate(tries))))).alias("variant"))
    first = both.agg(F.min("variant").alias("first"))
    return both.join(F.broadcast(first), F.col("variant") == F.col("first")).select("doc_id", "variant")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS points, count(*) >= 100 AS available FROM documents GROUP BY lang")
def collection_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Which collections are large enough to search."""
    return table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("points")).withColumn("available", F.col("points") >= 100)


#: Kinds of sections whose chunks count as important.
IMPORTANT = ["dispositive", "issues", "legal_analysis"]


def first_important(made: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` important chunks of every document, in the order in which they are cut out."""
    placed = made.where(F.col("section_type").isin(IMPORTANT)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")))
    return placed.where(F.col("n") <= n)


@query(CHUNKS_SQL + " SELECT doc_id, id, section, section_type, CAST(p AS INTEGER) AS paragraph_index, CAST(place AS INTEGER) AS n FROM (SELECT *, n AS p, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS place FROM chunked WHERE section_type IN ('dispositive', 'issues', 'legal_analysis')) WHERE place <= 5")
def important_section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """First five chunks of every case that hold its ruling, issues or arguments."""
    return first_important(all_chunks(spark, folder)).select("doc_id", F.col("chunk_id").alias("id"), "section", "section_type", "paragraph_index", "n")


#: What the questions of all messages ask for by number or justice.
LOOKED_UP_SQL = rf""", asked AS (SELECT conv_id, turn, regexp_matches(lower(trim(query)), '{extract.PONENTE_QUERY}') AS is_ponente, CASE WHEN regexp_matches(query, '(?i)A\.M\.\s+No') THEN 'A.M. No. ' || regexp_extract(query, '(?i)A\.M\.\s+No\.?\s*([A-Z0-9\-]+)', 1) END AS special,
      CASE WHEN NOT regexp_matches(query, '(?i)A\.M\.\s+No') THEN nullif(ltrim(coalesce(nullif(regexp_extract(query, '(?i)G\.?R\.?\s*NOS?\.?\s*([0-9\-]+)', 1), ''), regexp_extract(query, '\b(\d{{5,}})\b', 1)), '0'), '') END AS gr,
      CASE (conv_id + turn) % 12 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'Peralta' WHEN 1 THEN 'Lazaro-Javier' ELSE 'Gesmundo' END WHEN 6 THEN 'Lazaro-Javier' END AS justice FROM ({QUESTIONS_SQL})),
    routed AS (SELECT *, CASE WHEN is_ponente AND justice IS NOT NULL THEN 'ponente' WHEN special IS NOT NULL THEN 'special' WHEN gr IS NOT NULL THEN 'number' END AS route FROM asked),
    first AS (SELECT justice, doc_id FROM (SELECT justice, doc_id, row_number() OVER (PARTITION BY justice ORDER BY doc_id) AS n FROM (VALUES ('Peralta'), ('Lazaro-Javier'), ('Gesmundo')) j(justice) JOIN cases ON starts_with(ponente, upper(justice))) WHERE n <= 5),
    met AS (SELECT conv_id, turn, route, doc_id FROM routed JOIN first USING (justice) WHERE route = 'ponente' UNION ALL SELECT conv_id, turn, route, doc_id FROM routed JOIN cases ON special_number = special WHERE route = 'special'
      UNION ALL SELECT conv_id, turn, route, doc_id FROM routed JOIN cases ON gr_number = 'G.R. No. ' || gr WHERE route = 'number')
    SELECT conv_id, turn, route, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY doc_id) AS INTEGER) AS rank, doc_id, case_title AS title, coalesce(gr_number, special_number) AS number,
      CASE WHEN gr_number IS NULL THEN '**[' || special_number || '](am:' || regexp_extract(special_number, 'A\.M\.\s+No\.\s+([A-Z0-9\-]+)', 1) || ')**' ELSE '**[' || gr_number || '](gr:' || regexp_extract(gr_number, 'G\.R\.\s+No\.\s+([0-9\-]+)', 1) || ')**' END AS link, excerpt AS summary FROM met JOIN e USING (doc_id)"""


@query(SUMMARY_CTE + LOOKED_UP_SQL)
def looked_up_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of all messages on a number or a justice, from routing to the cases displayed."""
    asked = questions(spark, folder).select(F.struct("conv_id", "turn").alias("query_id"), "query")
    return engine.look_up(cases(spark, folder), asked).select("query_id.*", "route", "rank", "doc_id", "title", "number", "link", "summary")


@query()
def answered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions from routing to a summary."""
    asked = spark.createDataFrame(list(enumerate([*ASKED, "G.R. No. 100010", "A.M. No. P-13-2903"])), "query_id int, query string")
    return engine.answer(cases(spark, folder), asked)
