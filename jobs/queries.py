"""The jobs as queries: each runs twice into one new folder and gives its output as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.plans.cases import SPLIT
from docketry.plans.retrieval import TOKENS
from docketry.sources import scratch
from jobs import library_feed, retrieval_report


def job1_library_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Records and chunks of all documents, after a first run and one that finds nothing new."""
    output = scratch.path(spark, "library")
    for _ in range(2):
        library_feed.run(spark, f"{folder}/documents.parquet*", output, f"{output}/checkpoint")
    return library_feed.current(spark, output).select("doc_id", "lang", "status", "first_id", "n_chars", "chunk_index", "chunk_id", "token_count", F.md5(F.encode("content", "utf-8")).alias("digest"))


def job2_retrieval_report(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and summaries of all benchmark items, after two runs of one name."""
    output = scratch.path(spark, "report")
    for _ in range(2):
        retrieval_report.run(spark, f"{folder}/documents.parquet", f"{folder}/benchmark.parquet", output, "whole")
    hits, summary = retrieval_report.reports(spark, output)
    told = hits.select("run", "lang", "item_id", "rank", "doc_id", F.round("score", 6).alias("score"), F.round("recall_1", 6).alias("recall_1"), F.round("recall_2", 6).alias("recall_2"), "met")
    sums = summary.select("run", "lang", "questions", "answered", "hits", F.round("mean_recall_1", 6).alias("recall_1"), F.round("mean_recall_2", 6).alias("recall_2"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "on_target", "against")
    return told.unionByName(sums, allowMissingColumns=True)


_FEED_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, lang, coalesce(length(text), 0) AS n_chars, 'sha256:' || sha256(text) AS checksum FROM documents),
    f AS (SELECT checksum, min(doc_id) AS first_id FROM d WHERE text IS NOT NULL AND n_chars >= 500 GROUP BY checksum),
    r AS (SELECT d.*, first_id, CASE WHEN first_id IS NULL THEN 'short' WHEN first_id = doc_id THEN 'new' ELSE 'duplicate' END AS status FROM d LEFT JOIN f ON d.checksum = f.checksum AND n_chars >= 500),
    t AS (SELECT doc_id, {SPLIT.format('text')} AS sent FROM r WHERE status = 'new'),
    s AS (SELECT doc_id, sent, list_transform(sent, lambda x: CAST(greatest(1, length(x) // 4) AS INTEGER)) AS tok FROM t),
    w AS (SELECT doc_id, tok, 1 AS lo, 1 AS i, tok[1] AS total, CAST([] AS STRUCT(lo INTEGER, hi INTEGER)[]) AS done FROM s WHERE len(tok) > 0
      UNION ALL
      SELECT doc_id, tok, CASE WHEN cut THEN nlo ELSE lo END, i + 1, CASE WHEN cut THEN coalesce(list_sum(list_slice(tok, nlo, i)), 0) + tok[i + 1] ELSE total + tok[i + 1] END,
             CASE WHEN cut THEN list_append(done, {{'lo': lo, 'hi': i}}) ELSE done END
      FROM (SELECT *, total + tok[i + 1] > 640 AS cut,
              i + 1 - CAST(len(list_filter(range(1, i - lo + 2), lambda k: list_sum(list_slice(tok, i - k + 1, i)) <= 96)) AS INTEGER) AS nlo FROM w WHERE i < len(tok))),
    e AS (SELECT doc_id, list_append(done, {{'lo': lo, 'hi': i}}) AS done FROM w WHERE i = len(tok)),
    c AS (SELECT doc_id, unnest(done) AS p FROM e),
    k AS (SELECT doc_id, p, array_to_string(list_slice(sent, p.lo, p.hi), ' ') AS content FROM c JOIN s USING (doc_id)),
    n AS (SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p.lo, p.hi) - 1 AS INTEGER) AS chunk_index FROM k WHERE length(content) // 4 >= 200),
    u AS (SELECT n.*, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(checksum || '_' || chunk_index)) AS h FROM n JOIN d USING (doc_id))
    SELECT r.doc_id, r.lang, status, first_id, CAST(n_chars AS BIGINT) AS n_chars, chunk_index,
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
        CAST(length(content) // 4 AS INTEGER) AS token_count, md5(content) AS digest
    FROM r LEFT JOIN u USING (doc_id)"""

_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _recall_sql(n: int) -> str:
    """Recall of the reference's runs of ``n`` words in each hit."""
    side = lambda c: f"SELECT item_id, doc_id, g, count(*) AS n FROM (SELECT item_id, doc_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))) AS g FROM (SELECT item_id, doc_id, {_WORDS.format(c)} AS w FROM pairs)) GROUP BY ALL"
    return f"SELECT item_id, doc_id, sum(least(b.n, coalesce(a.n, 0))) / CAST(sum(b.n) AS DOUBLE) AS recall FROM ({side('reference')}) b LEFT JOIN ({side('response')}) a USING (item_id, doc_id, g) GROUP BY item_id, doc_id"


_REPORT_SQL = f"""WITH p AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
    tot AS (SELECT (SELECT count(*) FROM documents) AS n, sum(dl) AS total FROM dl),
    idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, tot GROUP BY term, n),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
    w AS (SELECT item_id, term, qtf, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM q JOIN idf USING (term)),
    sc AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS score FROM tf JOIN w USING (term) JOIN dl USING (doc_id), tot GROUP BY item_id, doc_id),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10),
    pairs AS (SELECT item_id, doc_id, rank, score, lang, b.text AS reference, d.text AS response FROM top JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
    r1 AS ({_recall_sql(1)}), r2 AS ({_recall_sql(2)}),
    h AS (SELECT item_id, rank, doc_id, score, coalesce(round(r1.recall, 9), 0) AS recall_1, coalesce(round(r2.recall, 9), 0) AS recall_2, coalesce(round(r1.recall, 9), 0) >= 0.6 AS met, lang FROM pairs LEFT JOIN r1 USING (item_id, doc_id) LEFT JOIN r2 USING (item_id, doc_id)),
    both_ AS (SELECT *, unnest([coalesce(lang, 'none'), 'all']) AS of FROM h),
    each_ AS (SELECT of, item_id, count(*) AS hits, sum(recall_1) AS r1, sum(recall_2) AS r2, min(rank) FILTER (met) AS first FROM both_ GROUP BY ALL),
    sums AS (SELECT of, CAST(count(*) AS BIGINT) AS answered, CAST(sum(hits) AS BIGINT) AS hits, sum(r1) / sum(hits) AS recall_1, sum(r2) / sum(hits) AS recall_2, sum(coalesce(1.0 / first, 0)) / (SELECT count(*) FROM benchmark) AS rr FROM each_ GROUP BY of)
    SELECT 'whole' AS run, lang, item_id, rank, doc_id, round(score, 6) AS score, round(recall_1, 6) AS recall_1, round(recall_2, 6) AS recall_2, met, CAST(NULL AS BIGINT) AS questions, CAST(NULL AS BIGINT) AS answered, CAST(NULL AS BIGINT) AS hits,
        CAST(NULL AS DOUBLE) AS reciprocal_rank, CAST(NULL AS BOOLEAN) AS on_target, CAST(NULL AS DOUBLE) AS against FROM h
    UNION ALL SELECT 'whole', of, NULL, NULL, NULL, NULL, round(recall_1, 6), round(recall_2, 6), NULL, (SELECT CAST(count(*) AS BIGINT) FROM benchmark), answered, hits, round(rr, 6), round(rr, 9) >= 0.5, NULL FROM sums"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Both jobs by name."""
    return {"job1_library_feed": job1_library_feed, "job2_retrieval_report": job2_retrieval_report}


def oracle_sql() -> dict[str, str]:
    """SQL of what each leaves."""
    return {"job1_library_feed": _FEED_SQL, "job2_retrieval_report": _REPORT_SQL}
