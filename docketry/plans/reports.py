"""Queries that summarise operations, test results and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.plans.registry import query
from docketry.sources.tables import table

SLOW = 5.0


def _operations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as metrics of operations."""
    return table(spark, folder, "events").select("event_id", "ts", F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"))


OPS = "ops AS (SELECT event_id, ts, event_type AS operation, value AS duration, event_type <> 'error' AS success FROM events)"


@query(f"WITH {OPS} SELECT operation, CAST(count(*) AS BIGINT) AS n, round(avg(duration), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, round(sum(duration), 4) AS total_duration FROM ops GROUP BY operation")
def perf_op_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Count and durations of every operation."""
    d = "duration"
    return _operations(spark, folder).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.round(F.sum(d), 4).alias("total_duration"))


@query(f"WITH {OPS} SELECT CAST(count(*) AS BIGINT) AS total_operations, CAST(count(*) FILTER (success) AS BIGINT) AS successes, CAST(count(*) FILTER (NOT success) AS BIGINT) AS failures, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate FROM ops")
def perf_session(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a session."""
    return _operations(spark, folder).agg(F.count(F.lit(1)).alias("total_operations"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))


@query("SELECT event_id, value AS duration FROM events WHERE value > 5.0")
def perf_slow_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Operations that take longer than the threshold."""
    return _operations(spark, folder).where(F.col("duration") > SLOW).select("event_id", "duration")


@query(f"WITH {OPS}, l AS (SELECT * FROM ops ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT operation, CAST(count(*) AS BIGINT) AS n, round(avg(duration), 6) AS avg_duration FROM l GROUP BY operation")
def perf_last_1000(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the last thousand operations."""
    last = _operations(spark, folder).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return last.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("avg_duration"))


@query(f"""WITH {OPS}, s AS (SELECT avg(duration) FILTER (operation = 'purchase') AS generation, avg(duration) FILTER (operation = 'view') AS retrieval, avg(CAST(success AS DOUBLE)) AS rate FROM ops)
    SELECT unnest(list_filter([CASE WHEN generation > 5.0 THEN 'Slow contextual generation' END, CASE WHEN retrieval > 3.0 THEN 'Slow retrieval operations' END, CASE WHEN rate < 0.9 THEN 'Low success rate' END], lambda x: x IS NOT NULL)) AS issue FROM s""")
def perf_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Issues that the averages point to."""
    mean = lambda op: F.avg(F.when(F.col("operation") == op, F.col("duration")))
    s = _operations(spark, folder).agg(mean("purchase").alias("generation"), mean("view").alias("retrieval"), F.avg(F.col("success").cast("double")).alias("rate"))
    issues = [F.when(F.col("generation") > 5.0, "Slow contextual generation"), F.when(F.col("retrieval") > 3.0, "Slow retrieval operations"), F.when(F.col("rate") < 0.9, "Low success rate")]
    return s.select(F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def upper_median(c: str) -> Column:
    """The middle value; of an even number the upper one of the two."""
    # Counted from above, so that values are tallied and never gathered in a list.
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").cast("int")


@query("""SELECT lang, round(avg(length(text)), 6) AS mean_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS INTEGER) AS upper_median,
    printf('%.1f%%', 100.0 * count(*) FILTER (contains(text, 'idiot')) / count(*)) AS share FROM documents GROUP BY lang""")
def quality_upper_median(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of answers, with the upper median, and a share as text."""
    n = table(spark, folder, "documents").select("lang", F.length("text").alias("n"), F.contains("text", F.lit("idiot")).alias("hit"))
    return n.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("mean_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), upper_median("n").alias("upper_median"), F.printf(F.lit("%.1f%%"), 100.0 * F.count_if("hit") / F.count(F.lit(1))).alias("share"))


@query(f"WITH {OPS} SELECT operation AS query_type, CAST(count(*) AS BIGINT) AS total, round(avg(CAST(duration < 50 AS DOUBLE)), 6) AS success_rate, round(avg(duration) FILTER (duration < 50), 6) AS avg_time FROM ops GROUP BY operation")
def query_type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Success by type of question; times over successes only."""
    good = F.col("duration") < 50
    return _operations(spark, folder).groupBy(F.col("operation").alias("query_type")).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(good.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(good, F.col("duration"))), 6).alias("avg_time"))


@query("""WITH s AS (SELECT avg(CAST(quality AS DOUBLE)) * 100 AS accuracy, avg(CAST(doc_id % 10 AS DOUBLE) / 10) * 100 AS relevance, avg(CAST(toxic AS DOUBLE)) * 100 AS rate, 25.0::DOUBLE AS baseline FROM labels)
    SELECT round(accuracy, 4) AS accuracy, round(relevance, 4) AS relevance, round(rate, 4) AS hallucination_rate, accuracy BETWEEN 75 AND 85 AS objective_1, relevance BETWEEN 50 AND 80 AS objective_2, rate <= 15 AND baseline - rate >= 10 AS objective_3 FROM s""")
def objective_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a run meets its three objectives, the third against a baseline of 25 percent."""
    mean = lambda c: F.avg(c.cast("double")) * 100
    s = table(spark, folder, "labels").agg(mean(F.col("quality")).alias("a"), mean((F.col("doc_id") % 10) / 10).alias("r"), mean(F.col("toxic")).alias("h"))
    return s.select(F.round("a", 4).alias("accuracy"), F.round("r", 4).alias("relevance"), F.round("h", 4).alias("hallucination_rate"), F.col("a").between(75, 85).alias("objective_1"), F.col("r").between(50, 80).alias("objective_2"), ((F.col("h") <= 15) & (25 - F.col("h") >= 10)).alias("objective_3"))


@query("SELECT source AS category, CAST(count(*) FILTER (n_chars >= 1000) AS BIGINT) AS passed, CAST(count(*) FILTER (n_chars < 1000 AND n_chars >= 100) AS BIGINT) AS failed, CAST(count(*) FILTER (n_chars < 100) AS BIGINT) AS errors, round(100.0 * count(*) FILTER (n_chars >= 1000) / count(*), 4) AS success FROM documents GROUP BY source")
def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Tests passed, failed and broken by category."""
    n = F.col("n_chars")
    return table(spark, folder, "documents").groupBy(F.col("source").alias("category")).agg(F.count_if(n >= 1000).alias("passed"), F.count_if((n < 1000) & (n >= 100)).alias("failed"), F.count_if(n < 100).alias("errors"), F.round(100.0 * F.count_if(n >= 1000) / F.count(F.lit(1)), 4).alias("success"))


@query("""WITH m AS (SELECT max(ts) AS last FROM events), r AS (SELECT value, CAST(user_id % 5 + 1 AS DOUBLE) AS helpfulness, event_type IN ('purchase', 'signup') AS predicted, user_id % 2 = 0 AS actual FROM events, m WHERE ts >= last - INTERVAL 30 DAY),
    c AS (SELECT count(*) AS n, avg(helpfulness) AS helpfulness, count(*) FILTER (predicted AND actual)::DOUBLE AS tp, count(*) FILTER (predicted AND NOT actual)::DOUBLE AS fp, count(*) FILTER (NOT predicted AND actual)::DOUBLE AS fn, count(*) FILTER (NOT predicted AND NOT actual)::DOUBLE AS tn FROM r)
    SELECT CAST(n AS BIGINT) AS total, round(helpfulness, 6) AS helpfulness, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity FROM c""")
def rating_window_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of the last thirty days."""
    events = table(spark, folder, "events")
    last = events.agg(F.max("ts").alias("last"))
    r = events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 30 DAYS")).select((F.col("user_id") % 5 + 1).cast("double").alias("h"), F.col("event_type").isin("purchase", "signup").alias("p"), (F.col("user_id") % 2 == 0).alias("a"))
    p, a = F.col("p"), F.col("a")
    c = r.agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    share = lambda x, y: F.round(F.expr(f"try_divide({x}, {y})"), 6)
    return c.select(F.col("n").alias("total"), F.round("h", 6).alias("helpfulness"), share("tp + tn", "n").alias("accuracy"), share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("tn", "tn + fp").alias("specificity"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day, the grain from which trailing windows add up."""
    day = F.window("ts", "1 day")
    return table(spark, folder, "events").groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT CAST(promulgation_year AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n_cases FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 2003 + doc_id % 20 END AS promulgation_year FROM documents) GROUP BY ALL")
def cases_per_year(spark: SparkSession, folder: str) -> DataFrame:
    """Processed cases by year; those of unknown year by themselves."""
    from docketry.sources.tables import cases

    return cases(spark, folder).groupBy(F.col("promulgation_year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n_cases"))


@query("SELECT round(avg(len(l)), 6) AS avg_labels, CAST((SELECT count(DISTINCT x) FROM (SELECT unnest([lang, source]) AS x FROM documents)) AS BIGINT) AS n_labels FROM (SELECT list_distinct([lang, source]) AS l FROM documents)")
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by example and how many different ones are used."""
    l = table(spark, folder, "documents").select(F.array_distinct(F.array("lang", "source")).alias("l"))  # noqa: E741
    used = l.select(F.explode("l").alias("x")).agg(F.count_distinct("x").alias("n_labels"))
    return l.agg(F.round(F.avg(F.size("l")), 6).alias("avg_labels")).crossJoin(F.broadcast(used))


@query("""WITH cur AS (SELECT avg(CAST(toxic AS DOUBLE)) * 100 AS rate FROM labels WHERE doc_id % 2 = 0), base AS (SELECT avg(CAST(toxic AS DOUBLE)) * 100 AS rate FROM labels WHERE doc_id % 2 = 1)
    SELECT round(cur.rate, 6) AS current_rate, round(base.rate, 6) AS baseline_rate, round(base.rate - cur.rate, 6) AS reduction FROM cur, base""")
def baseline_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """One run against another, one row each."""
    rate = lambda part, name: table(spark, folder, "labels").where(F.col("doc_id") % 2 == part).agg((F.avg(F.col("toxic").cast("double")) * 100).alias(name))
    both = rate(0, "c").crossJoin(F.broadcast(rate(1, "b")))
    return both.select(F.round("c", 6).alias("current_rate"), F.round("b", 6).alias("baseline_rate"), F.round(F.col("b") - F.col("c"), 6).alias("reduction"))


@query("SELECT event_type, CAST(ntile AS INTEGER) AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, event_id % 3 AS ntile FROM events) GROUP BY ALL")
def status_pivot_source(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by category and status, before they are spread over columns."""
    return table(spark, folder, "events").groupBy("event_type", (F.col("event_id") % 3).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))
