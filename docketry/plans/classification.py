"""Queries that classify cases by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import classify, extract, rules
from docketry.plans.cases import CTE, SUBJECT_CTE
from docketry.plans.registry import query
from docketry.sources.tables import cases, table


def _hits(words: list[str]) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(t, w)))"


@query(CTE + f""", c AS (SELECT doc_id, lower(clean_text) || chr(1) || lower(case_title) AS t, length(lower(clean_text)) AS n, lower(coalesce(gr_number, special_number)) AS g FROM cases),
    h AS (SELECT *, {", ".join(f"{_hits(ws)} AS {k}" for k, ws in rules.CASE_TYPE_WORDS.items())} FROM c),
    s AS (SELECT doc_id, {", ".join(f"CASE WHEN {k} > 0 THEN least({k} / 5.0::DOUBLE, 1.0::DOUBLE) {'WHEN criminal + administrative = 0 THEN 0.5::DOUBLE ' if k == 'civil' else ''}END AS {k}" for k in rules.CASE_TYPE_WORDS)},
      CASE WHEN contains(g, 'g.r. no.') OR contains(g, 'a.m.') THEN 'supreme_court' ELSE 'regional_trial_court' END AS jurisdiction, CASE WHEN contains(g, 'g.r. no.') THEN 0.9::DOUBLE WHEN contains(g, 'a.m.') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS jurisdiction_score,
      CASE WHEN n > 10000 THEN 'highly_complex' WHEN n > 5000 THEN 'complex' WHEN n > 2000 THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN n > 10000 THEN 0.8::DOUBLE WHEN n > 5000 THEN 0.7::DOUBLE WHEN n > 2000 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS complexity_score FROM h)
    SELECT doc_id, criminal, civil, administrative, jurisdiction, complexity, greatest(coalesce(criminal, 0), coalesce(civil, 0), coalesce(administrative, 0), jurisdiction_score, complexity_score) AS confidence FROM s""")
def rule_fallback_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Type, jurisdiction and complexity of every case with scores, without a model."""
    number = F.coalesce("gr_number", "special_number")
    made = cases(spark, folder).select("doc_id", classify.by_rules(F.col("case_title"), F.col("clean_text"), number).alias("c"))
    first = lambda k: F.element_at(F.map_keys(f"c.predictions.{k}"), 1)
    kinds = [F.try_element_at("c.predictions.case_type", F.lit(k)).alias(k) for k in rules.CASE_TYPE_WORDS]
    return made.select("doc_id", *kinds, first("jurisdiction_level").alias("jurisdiction"), first("complexity_level").alias("complexity"), F.col("c.confidence").alias("confidence"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _list(labels: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in labels) + "]"


@query(CTE + f""", c AS (SELECT doc_id, lower(case_title) || ' ' || lower(clean_text) AS t, upper(substr(clean_text, 1, 800)) AS u, special_number, gr_number, CASE doc_id % 4 WHEN 0 THEN 'Tax' WHEN 1 THEN 'unheard of' WHEN 2 THEN 'criminal' END AS case_type FROM cases),
    l AS (SELECT doc_id, CASE WHEN case_type IN ('Tax', 'criminal') THEN [lower(case_type)] ELSE [] END
      || CASE WHEN contains(u, 'EN BANC') THEN [] WHEN contains(u, 'FIRST DIVISION') THEN ['supreme_court'] WHEN regexp_matches(u, '(SECOND|THIRD) DIVISION') THEN ['appellate_court'] ELSE [] END
      || CASE WHEN contains(upper(special_number), 'A.M.') THEN ['administrative', 'administrative_law'] ELSE [] END || CASE WHEN gr_number IS NOT NULL THEN ['supreme_court'] ELSE [] END
      || CASE WHEN contains(u, 'EN BANC') THEN ['constitutional_law'] ELSE [] END || {" || ".join(f"CASE WHEN {_any(ws)} THEN {_list(ls)} ELSE [] END" for ws, ls in rules.LABEL_WORDS)} AS a FROM c)
    SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(a) = 0 THEN ['civil'] ELSE a END)), '|') AS labels FROM l""")
def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for training from the fields and the whole text of every case; civil by default."""
    case_type = F.element_at(F.array(F.lit("Tax"), F.lit("unheard of"), F.lit("criminal"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    division = extract.division(F.col("clean_text"))
    labels = classify.training_labels(F.col("case_title"), F.col("clean_text"), case_type, division, F.col("special_number"), F.col("gr_number"), division == "En Banc")
    return cases(spark, folder).select("doc_id", F.array_join(labels, "|").alias("labels"))


_HINTS = "CASE WHEN contains(g, 'a.m.') OR contains(t, 'administrative matter') THEN 'legal_ethics' " + " ".join(f"WHEN {_any(ws)} THEN '{s}'" for ws, s, _ in rules.SUBJECT_HINTS) + " END"


@query(SUBJECT_CTE + f""", m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM sc),
    a AS (SELECT doc_id, min(CASE WHEN place = 1 THEN subject END) AS first, string_agg(CASE WHEN place > 1 AND score >= 0.5 * best THEN subject END, '|' ORDER BY place) AS second, max(best) AS best FROM m GROUP BY doc_id),
    h AS (SELECT low.doc_id, {_HINTS} AS hint FROM (SELECT doc_id, lower(case_title || ' ' || clean_text) AS t, lower(coalesce(gr_number, special_number)) AS g FROM cases) low)
    SELECT h.doc_id, coalesce(a.first, hint) AS primary_subject, coalesce(CASE WHEN a.first IS NULL THEN CASE WHEN hint = 'legal_ethics' THEN 'political_law' END ELSE second END, '') AS secondary,
    CASE WHEN best >= 10 THEN 'high' WHEN best >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM h LEFT JOIN a USING (doc_id)""")
def bar_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every case; those without any keyword go by hints."""
    made = cases(spark, folder).select("doc_id", classify.subjects(F.col("case_title"), F.col("clean_text"), F.coalesce("gr_number", "special_number")).alias("s"))
    return made.select("doc_id", F.col("s.primary").alias("primary_subject"), F.array_join("s.secondary", "|").alias("secondary"), "s.confidence")


@query("""WITH p AS (SELECT vec_id, i, round(1 / (1 + exp(4 - 6 * CAST(embedding[i + 1] AS DOUBLE))), 9) AS score FROM embeddings, range(20) t(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, lpad(CAST(i AS VARCHAR), 2, '0')) AS place, max(score) OVER (PARTITION BY vec_id) > 0.1 AS sure FROM p)
    SELECT vec_id, string_agg(lpad(CAST(i AS VARCHAR), 2, '0'), '|' ORDER BY place) AS labels FROM r WHERE CASE WHEN sure THEN score > 0.1 ELSE place <= 5 AND score > 0.01 END GROUP BY vec_id""")
def label_picks(spark: SparkSession, folder: str) -> DataFrame:
    """Labels above a threshold for every vector of logits; without any the five best that are not negligible."""
    scored = F.transform(F.slice("embedding", 1, 20), lambda x, i: F.struct(F.lpad(i.cast("string"), 2, "0").alias("label"), F.round(1 / (1 + F.exp(4 - 6 * x.cast("double"))), 9).alias("score")))
    picked = table(spark, folder, "embeddings").select("vec_id", classify.picked_labels(scored).alias("p")).where(F.size("p") > 0)
    return picked.select("vec_id", F.array_join(F.transform("p", lambda x: x["label"]), "|").alias("labels"))


@query(CTE + " SELECT doc_id, case_title, coalesce(gr_number, '') AS gr_number, CAST(length(lower(clean_text)) AS INTEGER) AS content_length, CAST(1700000000 AS BIGINT) AS classification_timestamp FROM cases")
def classification_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What each case is classified from; the first field that says something counts."""
    odd = cases(spark, folder).select("doc_id", F.lit("").alias("case_title"), F.col("case_title").alias("title"), F.lit("").alias("content"), "clean_text", "gr_number")
    return classify.classified(odd, F.timestamp_seconds(F.lit(1700000000))).select("doc_id", "input_metadata.*")
