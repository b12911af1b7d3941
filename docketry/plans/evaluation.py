"""Queries that score answers and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import rules
from docketry.operators import evaluate
from docketry.plans.registry import query
from docketry.sources.tables import QUESTIONS_SQL, questions, spread, table

PAIRS_SQL = "SELECT b.item_id AS pair_id, d.text AS response, b.text AS reference, 'What is the decision and ruling of case ' || d.lang || ' about facts that th' AS query, CAST(b.item_id % 20 AS DOUBLE) / 20 AS bert FROM benchmark b JOIN documents d ON d.doc_id = b.item_id"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("response"), "lang")
    refs = table(spark, folder, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("reference"))
    asked = F.concat(F.lit("What is the decision and ruling of case "), F.col("lang"), F.lit(" about facts that th"))
    return docs.join(refs, "pair_id").select("pair_id", "response", "reference", asked.alias("query"), ((F.col("pair_id") % 20).cast("double") / 20).alias("bert"))


def _grams(n: int) -> str:
    words = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    side = lambda c, out: f"{out} AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))) AS g FROM (SELECT pair_id, {words(c)} AS w FROM pairs)) GROUP BY ALL)"
    return f"""WITH pairs AS ({PAIRS_SQL}), {side('response', 'a')}, {side('reference', 'b')},
    s AS (SELECT pair_id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS DOUBLE) AS hit, CAST(coalesce(sum(a.n), 0) AS DOUBLE) AS own, CAST(coalesce(sum(b.n), 0) AS DOUBLE) AS theirs FROM a FULL JOIN b USING (pair_id, g) GROUP BY pair_id),
    r AS (SELECT pair_id, CASE WHEN own > 0 THEN hit / own ELSE 0 END AS p, CASE WHEN theirs > 0 THEN hit / theirs ELSE 0 END AS r FROM s)
    SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("pair_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_grams(1))
def rouge1(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap in single words."""
    return _rounded(evaluate.rouge_n(_pairs(spark, folder), 1))


@query(_grams(1).replace("SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r", "SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS rouge_1, round(avg(bert), 6) AS bert, round(100.0 * avg(CASE WHEN bert >= 0.5 THEN 1 ELSE 0 END), 4) AS accuracy FROM r JOIN pairs USING (pair_id)"))
def average_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of the scores of a run of tests."""
    pairs = _pairs(spark, folder)
    scores = evaluate.rouge_n(pairs, 1).select("pair_id", "f1").join(pairs.select("pair_id", "bert"), "pair_id")
    return scores.agg(F.round(F.avg("f1"), 6).alias("rouge_1"), F.round(F.avg("bert"), 6).alias("bert"), F.round(F.avg((F.col("bert") >= 0.5).cast("double")) * 100, 4).alias("accuracy"))


@query(_grams(2))
def rouge2(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap in pairs of words."""
    return _rounded(evaluate.rouge_n(_pairs(spark, folder), 2))


_WORDS_OF = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _subsequences(pairs: str, name: str) -> str:
    """The longest common subsequence of words, a word of the response after the other; words that the reference lacks change nothing."""
    return f"""lw AS (SELECT pair_id, len(a) AS own, len(b) AS theirs, list_filter(a, lambda w: list_contains(b, w)) AS a, b FROM (SELECT pair_id, {_WORDS_OF.format('response')} AS a, {_WORDS_OF.format('reference')} AS b FROM {pairs})),
    lcs AS (SELECT pair_id, 0 AS i, list_transform(b, lambda w: 0) AS line FROM lw UNION ALL
      SELECT pair_id, i + 1, list_transform(line, lambda v, j: list_max(list_slice(list_transform(line, lambda u, k: greatest(u, CASE WHEN b[k] = a[i + 1] THEN CASE WHEN k > 1 THEN line[k - 1] ELSE 0 END + 1 ELSE 0 END)), 1, j))) FROM lcs JOIN lw USING (pair_id) WHERE i < len(a)),
    lh AS (SELECT pair_id, CAST(max(coalesce(list_max(line), 0)) AS DOUBLE) AS hit FROM lcs GROUP BY pair_id),
    {name} AS (SELECT pair_id, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT pair_id, CASE WHEN own > 0 THEN hit / own ELSE 0 END AS p, CASE WHEN theirs > 0 THEN hit / theirs ELSE 0 END AS r FROM lw JOIN lh USING (pair_id)))"""


@query(f"WITH RECURSIVE pairs AS ({PAIRS_SQL}), {_subsequences('pairs', 'rl')} SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM rl")
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap in the longest common subsequence."""
    return _rounded(evaluate.rouge_l(_pairs(spark, folder)))


#: Each document as an answer with two of all references.
BEST_SQL = f"""WITH p AS (SELECT d.doc_id, b.item_id, d.text AS response, b.text AS reference FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % (SELECT count(*) FROM benchmark), (d.doc_id * 7 + 1) % (SELECT count(*) FROM benchmark))),
    a AS (SELECT doc_id, item_id, g, count(*) AS n FROM (SELECT doc_id, item_id, unnest({_WORDS_OF.format('response')}) AS g FROM p) GROUP BY ALL), b AS (SELECT doc_id, item_id, g, count(*) AS n FROM (SELECT doc_id, item_id, unnest({_WORDS_OF.format('reference')}) AS g FROM p) GROUP BY ALL),
    s AS (SELECT doc_id, item_id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS DOUBLE) AS hit, CAST(coalesce(sum(a.n), 0) AS DOUBLE) AS own, CAST(coalesce(sum(b.n), 0) AS DOUBLE) AS theirs FROM a FULL JOIN b USING (doc_id, item_id, g) GROUP BY ALL),
    r AS (SELECT doc_id, item_id, CASE WHEN own > 0 THEN hit / own ELSE 0 END AS p, CASE WHEN theirs > 0 THEN hit / theirs ELSE 0 END AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r)"""


def _two_references(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    count = items.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n"))
    chosen = F.array_distinct(F.array(F.col("doc_id") % F.col("n"), (F.col("doc_id") * 7 + 1) % F.col("n")))
    docs = table(spark, folder, "documents").crossJoin(F.broadcast(count)).select("doc_id", F.col("text").alias("response"), F.explode(chosen).alias("item_id"))
    pairs = docs.join(items.select("item_id", F.col("text").alias("reference")), "item_id")
    keyed = pairs.withColumn("pair", F.struct("doc_id", "item_id"))
    return evaluate.rouge_n(keyed, 1, "pair").select("pair.doc_id", "pair.item_id", "precision", "recall", "f1")


@query(BEST_SQL + " SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(f, 12) DESC, item_id) AS n FROM f) WHERE n = 1")
def best_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and f1 of every document against the better of its two references; the first one wins a tie."""
    scored = _two_references(spark, folder).withColumn("f1", F.round("f1", 12))
    return evaluate.best_reference(scored, "doc_id", "item_id").select("doc_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(BEST_SQL + " SELECT doc_id, round(max(p), 4) AS precision, round(max(r), 4) AS recall, round(max(f), 4) AS f1 FROM f GROUP BY doc_id")
def best_components(spark: SparkSession, folder: str) -> DataFrame:
    """The best precision, recall and f1 of every document over its two references, each by itself."""
    return evaluate.best_components(_two_references(spark, folder), "doc_id")


@query(f"WITH pairs AS ({PAIRS_SQL}) SELECT pair_id, CAST(0 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS f1 FROM pairs")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by a model where there is none."""
    return evaluate.model_scores(_pairs(spark, folder))


def _section_sql(c: str, name: str) -> str:
    words, patterns = rules.DIGEST_WORDS[name], rules.DIGEST_PATTERNS[name]
    listed = ", ".join(f"'{w}'" for w in words)
    found = " + ".join(f"CAST(regexp_matches(lower({c}), '{p}') AS INTEGER)" for p in patterns)
    return f"(0.7::DOUBLE * len(list_filter([{listed}], lambda w: contains(lower({c}), w))) / {float(len(words))} + 0.3::DOUBLE * ({found}) / {float(len(patterns))})"


@query(f"WITH pairs AS ({PAIRS_SQL}) SELECT pair_id, " + ", ".join(f"round({_section_sql('query || response', n)}, 4) AS {n}" for n in rules.DIGEST_WORDS) + " FROM pairs")
def section_identification(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the sections of a digest."""
    scores = evaluate.section_scores(F.concat("query", "response"))
    return _pairs(spark, folder).select("pair_id", scores.alias("s")).select("pair_id", *(F.round(F.element_at("s", n), 4).alias(n) for n in rules.DIGEST_WORDS))


def _flags(c: str) -> str:
    return ", ".join(f"CASE WHEN {_section_sql(c, n)} > 0.3 THEN '{n}' END" for n in ("facts", "ruling"))


@query(f"""WITH pairs AS ({PAIRS_SQL}), f AS (SELECT pair_id, list_filter([{_flags("query || ' background respondent accused held ordered wherefore decreed'")}], lambda x: x IS NOT NULL) AS a, list_filter([{_flags("reference || ' held ordered wherefore decision'")}], lambda x: x IS NOT NULL) AS b FROM pairs),
    s AS (SELECT pair_id, len(a) AS own, len(b) AS theirs, len(list_intersect(a, b)) AS hit FROM f),
    r AS (SELECT *, CASE WHEN own > 0 THEN hit / CAST(own AS DOUBLE) ELSE 0 END AS p, CASE WHEN theirs > 0 THEN hit / CAST(theirs AS DOUBLE) ELSE 0 END AS r FROM s)
    SELECT pair_id, round((2 - (own - hit) - (theirs - hit)) / 2.0::DOUBLE, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, CAST(theirs - hit AS INTEGER) AS n_missing, CAST(own - hit AS INTEGER) AS n_extra FROM r""")
def section_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of an answer against those of its reference, where the question asks for them."""
    ours = F.concat("query", F.lit(" background respondent accused held ordered wherefore decreed"))
    theirs = F.concat("reference", F.lit(" held ordered wherefore decision"))
    told = evaluate.compare_sections(ours, theirs, evaluate.expected_sections(F.col("query")))
    return _pairs(spark, folder).select("pair_id", told.alias("s")).select("pair_id", "s.accuracy", "s.precision", "s.recall", "s.f1", F.size("s.missing").alias("n_missing"), F.size("s.extra").alias("n_extra"))


@query(f"""SELECT conv_id, turn, CASE WHEN d OR NOT (f OR i OR r) THEN 'facts|issues|ruling' ELSE concat_ws('|', CASE WHEN f THEN 'facts' END, CASE WHEN i THEN 'issues' END, CASE WHEN r THEN 'ruling' END) END AS expected
    FROM (SELECT conv_id, turn, contains(q, 'fact') AS f, contains(q, 'issue') AS i, contains(q, 'ruling') OR contains(q, 'decision') OR contains(q, 'held') AS r, contains(q, 'digest') OR (contains(q, 'covering') AND contains(q, 'main')) AS d FROM (SELECT *, lower(coalesce(query, '')) AS q FROM ({QUESTIONS_SQL})))""")
def expected_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that the questions of all messages ask for."""
    return questions(spark, folder).select("conv_id", "turn", F.array_join(evaluate.expected_sections(F.col("query")), "|").alias("expected"))


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) > {1}))"


@query(f"""WITH pairs AS ({PAIRS_SQL}), w AS (SELECT pair_id, lower(response) AS low, {_WORDS.format('query', 3)} AS q, {_WORDS.format('response', 0)} AS r FROM pairs),
    rel AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in rules.RELATED.items())}) AS t(word, related)),
    b AS (SELECT pair_id, 0.5::DOUBLE * count(*) AS bonus FROM w JOIN rel ON list_contains(q, word) AND len(list_filter(string_split(related, '|'), lambda s: contains(low, s))) > 0 GROUP BY pair_id)
    SELECT pair_id, round(least(1.0, len(list_intersect(q, r)) / CAST(len(q) AS DOUBLE) + least(coalesce(bonus, 0) / len(q), 0.3)), 6) AS relevance FROM w LEFT JOIN b USING (pair_id)""")
def query_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """How far answers take up the words of their question."""
    return _pairs(spark, folder).select("pair_id", F.round(evaluate.query_relevance(F.col("query"), F.col("response")), 6).alias("relevance"))


_STOP = "[" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "]"


@query(f"""WITH pairs AS ({PAIRS_SQL}), w AS (SELECT pair_id, list_filter({_WORDS.format('query', 0)}, lambda x: NOT list_contains({_STOP}, x)) AS q, {_WORDS.format('response', 0)} AS r, {_WORDS.format('reference', 0)} AS c FROM pairs),
    s AS (SELECT pair_id, list_intersect(q, c) AS s, r FROM w) SELECT pair_id, CAST(len(s) AS INTEGER) AS n_shared, round(CASE WHEN len(s) > 0 THEN len(list_intersect(s, r)) / CAST(len(s) AS DOUBLE) ELSE 0 END, 6) AS overlap FROM s""")
def context_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a question that its context has, and how many of those the answer has."""
    stop = F.array(*map(F.lit, rules.STOP_WORDS))
    words = lambda c: F.array_except(F.array_distinct(evaluate.ascii_tokens(F.col(c), 1)), stop)
    shared = _pairs(spark, folder).select("pair_id", F.array_intersect(words("query"), words("reference")).alias("s"), words("response").alias("r"))
    return shared.select("pair_id", F.size("s").alias("n_shared"), F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("s", "r")), F.size("s")), F.lit(0.0)), 6).alias("overlap"))


#: Two answers for every document: its own text, and its reference in other words around it; questions ask for a digest, for some sections, for none, or nothing. Both SQL dialects read it.
ANSWERS_SQL = """
SELECT doc_id * 2 + kind AS pair_id,
  CASE (doc_id + kind) % 4 WHEN 0 THEN concat('Digest of the case on ', lang) WHEN 1 THEN 'What are the facts and the decision of the court?' WHEN 2 THEN concat('What did ', source, ' say on the respondent?') ELSE '' END AS query,
  concat(CASE WHEN kind = 0 THEN coalesce(text, '') ELSE concat('On this question ', reference, ' as held in ', lang) END,
    CASE doc_id % 3 WHEN 0 THEN ' background antecedents of petitioner and respondent ' WHEN 1 THEN ' held ordered decreed wherefore it is ordered ' ELSE '' END) AS response,
  concat(reference, CASE WHEN item_id % 2 = 0 THEN ' the decision held and ordered, wherefore ' ELSE ' facts and background of petitioner and accused ' END) AS reference
FROM (SELECT doc_id, d.text, lang, source, kind, b.item_id, coalesce(b.text, '') AS reference
  FROM documents d CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 AS kind) k CROSS JOIN (SELECT count(*) AS n FROM benchmark) c JOIN (SELECT item_id, text FROM benchmark) b ON b.item_id = d.doc_id % nullif(c.n, 0)) x
"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, query, response, reference): two answers for every document."""
    named = ANSWERS_SQL.replace("FROM documents", "FROM {documents}").replace("FROM benchmark", "FROM {benchmark}")
    return spark.sql(named, documents=spread(table(spark, folder, "documents")).select("doc_id", "text", "lang", "source"), benchmark=table(spark, folder, "benchmark").select("item_id", "text"))


def _n_grams(n: int) -> str:
    side = lambda c, out: f"{out}{n} AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))) AS g FROM (SELECT pair_id, {_WORDS_OF.format(c)} AS w FROM answers)) GROUP BY ALL)"
    return f"""{side('response', 'a')}, {side('reference', 'b')},
    s{n} AS (SELECT pair_id, CAST(sum(least(coalesce(a{n}.n, 0), coalesce(b{n}.n, 0))) AS DOUBLE) AS hit, CAST(coalesce(sum(a{n}.n), 0) AS DOUBLE) AS own, CAST(coalesce(sum(b{n}.n), 0) AS DOUBLE) AS theirs FROM a{n} FULL JOIN b{n} USING (pair_id, g) GROUP BY pair_id),
    f{n} AS (SELECT pair_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT pair_id, CASE WHEN own > 0 THEN hit / own ELSE 0 END AS p, CASE WHEN theirs > 0 THEN hit / theirs ELSE 0 END AS r FROM s{n}))"""


_PLACES = "CAST(round(CAST({0} AS DECIMAL(24, 12)), 4) AS DOUBLE)"
#: Words of both sides by their rarity among the references, after the n-grams of one word.
RARE_SQL = f"""df AS (SELECT g, count(*) AS df FROM b1 GROUP BY g),
    m AS (SELECT pair_id, a1.n AS a, b1.n AS b, ln(((SELECT count(*) FROM answers) + 1)::DOUBLE / (coalesce(df, 0) + 1)) AS w FROM a1 FULL JOIN b1 USING (pair_id, g) LEFT JOIN df USING (g)),
    rare AS (SELECT pair_id, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT pair_id, coalesce(sum(a * w) FILTER (b IS NOT NULL) / nullif(sum(a * w), 0), 0) AS p, coalesce(sum(b * w) FILTER (a IS NOT NULL) / nullif(sum(b * w), 0), 0) AS r FROM m GROUP BY pair_id))"""


def _compared(asked: str) -> str:
    """The f1 of those sections of a digest that ``asked`` lists."""
    sections = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {_section_sql(c, n)} > 0.3 THEN '{n}' END" for n in rules.DIGEST_WORDS) + f"], lambda x: x IS NOT NULL AND list_contains({asked}, x))"
    return f"(SELECT CASE WHEN len(o) + len(t) > 0 THEN {_PLACES.format('2.0::DOUBLE * len(list_intersect(o, t)) / (len(o) + len(t))')} ELSE 0::DOUBLE END FROM (SELECT {sections('response')} AS o, {sections('reference')} AS t))"


_ASKED = """CASE WHEN contains(lq, 'digest') OR contains(lq, 'covering') AND contains(lq, 'main') OR NOT (contains(lq, 'fact') OR contains(lq, 'issue') OR contains(lq, 'ruling') OR contains(lq, 'decision') OR contains(lq, 'held')) THEN ['facts', 'issues', 'ruling']
    ELSE list_filter([CASE WHEN contains(lq, 'fact') THEN 'facts' END, CASE WHEN contains(lq, 'issue') THEN 'issues' END, CASE WHEN contains(lq, 'ruling') OR contains(lq, 'decision') OR contains(lq, 'held') THEN 'ruling' END], lambda x: x IS NOT NULL) END"""
#: All scores of the answers.
RUN_SQL = f"""WITH RECURSIVE answers AS ({ANSWERS_SQL}), {_n_grams(1)}, {_n_grams(2)}, {_subsequences('answers', 'rl')}, {RARE_SQL},
    w AS (SELECT pair_id, lower(response) AS low, {_WORDS.format('query', 3)} AS q, {_WORDS.format('response', 0)} AS r FROM answers WHERE query <> ''),
    related AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in rules.RELATED.items())}) AS t(word, related)),
    extra AS (SELECT pair_id, 0.5::DOUBLE * count(*) AS bonus FROM w JOIN related ON list_contains(q, word) AND len(list_filter(string_split(related, '|'), lambda s: contains(low, s))) > 0 GROUP BY pair_id),
    rel AS (SELECT pair_id, CASE WHEN len(q) = 0 THEN 0.5 ELSE least(1.0, len(list_intersect(q, r)) / CAST(len(q) AS DOUBLE) + least(coalesce(bonus, 0) / len(q), 0.3)) END AS relevance FROM w LEFT JOIN extra USING (pair_id)),
    digests AS (SELECT pair_id, {_compared("['facts', 'issues', 'ruling']")} AS dg, {_compared('asked')} AS ag FROM (SELECT *, {_ASKED} AS asked FROM (SELECT *, lower(query) AS lq FROM answers))),
    scores AS (SELECT pair_id, {', '.join(_PLACES.format(f'coalesce({t}.f1, 0)') + f' AS {c}' for t, c in (('f1', 'r1'), ('f2', 'r2'), ('rl', 'rl'), ('rare', 'bert')))}, dg, ag, relevance
      FROM answers LEFT JOIN f1 USING (pair_id) LEFT JOIN f2 USING (pair_id) LEFT JOIN rl USING (pair_id) LEFT JOIN rare USING (pair_id) JOIN digests USING (pair_id) LEFT JOIN rel USING (pair_id)),
    mean AS (SELECT *, (bert * 0.6::DOUBLE + r1 * 0.2::DOUBLE + r2 * 0.1::DOUBLE + rl * 0.1::DOUBLE) AS content, bert < 0.85 OR r1 < 0.45 AS detected FROM scores),
    raised AS (SELECT *, 1.65::DOUBLE * CASE WHEN relevance IS NULL THEN (content * 0.6::DOUBLE + ag * 0.2::DOUBLE) / 0.8::DOUBLE ELSE content * 0.6::DOUBLE + ag * 0.2::DOUBLE + relevance * 0.2::DOUBLE END AS raised FROM mean),
    run AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN raised < 0.4 THEN raised * 1.15::DOUBLE ELSE raised END)) AS quality FROM raised)"""
_LEVEL = "CASE WHEN quality >= 0.8 THEN 'HIGH' WHEN quality >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
_ISSUES = "CAST((bert < 0.4)::INT + (r1 < 0.4)::INT + (ag < 0.5)::INT + detected::INT AS INTEGER)"
_DEPARTS = f"""{_PLACES.format('(bert * 0.7::DOUBLE + r1 * 0.3::DOUBLE)')} AS consistency, {_PLACES.format("CASE WHEN detected THEN greatest(0.0, 1 - (greatest(0.0, (0.85::DOUBLE - bert) / 0.85) * 0.7::DOUBLE + greatest(0.0, (0.45::DOUBLE - r1) / 0.45) * 0.3::DOUBLE)) ELSE least(1.0, (bert - 0.85::DOUBLE) / (1 - 0.85::DOUBLE)) * 0.7::DOUBLE + least(1.0, (r1 - 0.45::DOUBLE) / (1 - 0.45::DOUBLE)) * 0.3::DOUBLE END")} AS confidence"""
_OVERALL = _PLACES.format("(bert * 0.7::DOUBLE + (r1 + r2 + rl) / 3 * 0.15::DOUBLE + dg * 0.15::DOUBLE)")


def _run(spark: SparkSession, folder: str) -> DataFrame:
    pairs = answers(spark, folder)
    return evaluate.evaluated(pairs, semantic=evaluate.rare_overlap(pairs))


@query(f"WITH answers AS ({ANSWERS_SQL}), {_n_grams(1)}, {RARE_SQL} SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM rare")
def rare_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words that answers share with their references, by rarity."""
    return _rounded(evaluate.rare_overlap(answers(spark, folder)))


@query(RUN_SQL + f" SELECT pair_id, r1, r2, rl, bert, dg AS digest_f1, detected, {_DEPARTS}, {_OVERALL} AS overall, {_PLACES.format('quality')} AS accuracy_score, {_LEVEL} AS accuracy_level, CASE {_LEVEL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in evaluate.ADVICE.items())} END AS recommendation, {_ISSUES} AS n_issues, quality >= 0.65 AS met FROM run")
def evaluated_answers(spark: SparkSession, folder: str) -> DataFrame:
    """All scores of answers against their references, from overlap to issues."""
    return _run(spark, folder).select("pair_id", "r1", "r2", "rl", "bert", "digest_f1", "hallucination.*", "overall", "accuracy_score", "accuracy_level", "recommendation", F.size("issues").alias("n_issues"), F.col("quality_threshold_met").alias("met"))


@query(RUN_SQL + f" SELECT pair_id, detected, {_DEPARTS} FROM run")
def hallucination_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Which answers depart from their reference."""
    return _run(spark, folder).select("pair_id", "hallucination.*")


@query(RUN_SQL + f" SELECT pair_id, {_PLACES.format('quality')} AS quality, {_LEVEL} AS level, quality >= 0.65 AS met, {_ISSUES} AS n_issues FROM run")
def composite_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of answers by the scores they were given, its level and the issues behind it."""
    return _run(spark, folder).select("pair_id", F.col("accuracy_score").alias("quality"), F.col("accuracy_level").alias("level"), F.col("quality_threshold_met").alias("met"), F.size("issues").alias("n_issues"))


@query(RUN_SQL + f" SELECT pair_id, {_OVERALL} AS overall FROM run")
def overall_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Content relevance of answers by the scores they were given."""
    return _run(spark, folder).select("pair_id", "overall")


LABEL_SQL = "SELECT doc_id AS example, 'quality' AS label, quality AS truth, CAST(length(text) > 800 AS INTEGER) AS guess FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic, CAST(contains(text, 'idiot') OR contains(text, 'clown') AS INTEGER) FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH p AS ({LABEL_SQL}), c AS (SELECT label, sum(truth * guess)::DOUBLE AS tp, sum((1 - truth) * guess)::DOUBLE AS fp, sum(truth * (1 - guess))::DOUBLE AS fn, sum((1 - truth) * (1 - guess))::DOUBLE AS tn FROM p GROUP BY label),
    m AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m),
    e AS (SELECT avg(same) AS accuracy FROM (SELECT example, min(CAST(truth = guess AS INTEGER)) AS same FROM p GROUP BY example))
    SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1, round(sum(tn) / (sum(tn) + sum(fp)), 6) AS specificity, round(any_value(accuracy), 6) AS accuracy FROM f, e""")
def multilabel_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of a rule classifier over two labels."""
    both = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    rude = F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("clown"))
    rows = both.select(F.col("doc_id").alias("example"), F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("truth"), (F.length("text") > 800).cast("int").alias("guess")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("truth"), rude.cast("int").alias("guess")))).alias("r"))
    out = evaluate.multilabel(rows.select("example", "r.*"))
    return out.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "specificity", "accuracy")))


@query("""WITH l AS (SELECT vec_id, label, 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE) * 10)) AS p, CASE WHEN label < 4 THEN 'area' WHEN label < 8 THEN 'form' ELSE 'other' END AS category FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(p, 9) DESC, vec_id) AS n FROM l WHERE p > 0.1) SELECT category, vec_id, label, round(p, 6) AS p FROM r WHERE n <= 5""")
def label_organise(spark: SparkSession, folder: str) -> DataFrame:
    """Five best labels of every category by the probability that a logit gives; labels map to categories."""
    taxonomy = spark.createDataFrame([(k, "area" if k < 4 else "form" if k < 8 else "other") for k in range(10)], "label int, category string")
    p = 1 / (1 + F.exp(-F.element_at("embedding", 1).cast("double") * 10))
    rows = table(spark, folder, "embeddings").select("vec_id", "label", p.alias("p")).where("p > 0.1").join(F.broadcast(taxonomy), "label")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(F.round("p", 9)), "vec_id")))
    return best.where("n <= 5").select("category", "vec_id", "label", F.round("p", 6).alias("p"))
