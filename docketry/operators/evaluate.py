"""Scores of answers against references."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import rules
from docketry.functions.text import ascii_tokens, let
from docketry.operators.search import FEW
from docketry.session import ship
from docketry.sources import scratch

BERT_FROM, ROUGE_FROM = 0.85, 0.45


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; zero where both are."""
    return _ratio(2 * precision * recall, precision + recall)


def _plain(c: str) -> Column:
    """A text's words in lower case, parted by blanks."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")


def _low(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


#: Words of a text in lower case, the same as those of ``_plain``.
CUT = re.compile("[a-z0-9]+").findall


def _words(pairs: DataFrame, *kinds: int | str) -> Column:
    """Words of both sides (own, theirs) of a pair, and for each of ``kinds`` what they share: n-grams with clipped counts, or "l" for the longest common subsequence.

    All within the row, so that no words are shuffled.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("own long, theirs long, " + ", ".join(f"hit_{k} long" for k in kinds))
    def run(responses: pd.Series, references: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(map(CUT, responses), map(CUT, references)):
            rows.append((len(a), len(b), *(_common_subsequence(b, a) if k == "l" else _common_grams(a, b, k) for k in kinds)))
        return pd.DataFrame(rows, columns=["own", "theirs", *(f"hit_{k}" for k in kinds)])

    return run(_low("response"), _low("reference"))


def _scores(words: Column, kind: int | str) -> list[Column]:
    """Precision, recall and f1 of what ``_words`` counted."""
    less = 0 if kind == "l" else kind - 1
    p, r = (_ratio(words[f"hit_{kind}"], F.greatest(words[c] - less, F.lit(0))) for c in ("own", "theirs"))
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def recalls(pairs: DataFrame, *kinds: int) -> Column:
    """What share of the reference's n-grams the response has, as a struct of recall_n for each of ``kinds``."""
    return let(_words(pairs, *kinds), lambda w: F.struct(*(_scores(w, n)[1].alias(f"recall_{n}") for n in kinds)))


def rouge_n(pairs: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """(key, precision, recall, f1): n-grams of ``response`` and ``reference`` with clipped counts."""
    return pairs.select(key, _words(pairs, n).alias("_w")).select(key, *_scores(F.col("_w"), n))


def _common_grams(a: list[str], b: list[str], n: int) -> int:
    """How many n-grams of one list the other has as well, repeats as often as both have them."""
    grams = lambda w: w if n == 1 else zip(*(w[i:] for i in range(n)))
    theirs = Counter(grams(b))
    ours = Counter(filter(theirs.__contains__, grams(a)))
    return sum(min(m, theirs[g]) for g, m in ours.items())


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in bits of one long integer, one for each word of ``a``; the shorter list goes first."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    # Words that the other list lacks change nothing.
    for hit in map(places.__getitem__, filter(places.__contains__, b)):
        hit &= row
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, precision, recall, f1) by the longest common subsequence of words."""
    return pairs.select(key, _words(pairs, "l").alias("_w")).select(key, *_scores(F.col("_w"), "l"))


def best_reference(scored: DataFrame, key: str, reference: str, metrics: list[str] = ("precision", "recall", "f1")) -> DataFrame:
    """For each answer the precision, recall and f1 against the reference with the best f1; the first one wins a tie, and without any overlap all are zero."""
    best = F.max_by(F.struct(*metrics), F.struct(F.col("f1"), -F.col(reference)))
    return scored.groupBy(key).agg(best.alias("b"), F.max("f1").alias("_top")).select(key, *(F.when(F.col("_top") > 0, F.col(f"b.{m}")).otherwise(0.0).alias(m) for m in metrics))


def best_components(scored: DataFrame, key: str, metrics: list[str] = ("precision", "recall", "f1")) -> DataFrame:
    """For each answer the best of each component over all references, each by itself, to four places."""
    return scored.groupBy(key).agg(*(F.round(F.greatest(F.max(m), F.lit(0.0)), 4).alias(m) for m in metrics))


def model_scores(pairs: DataFrame, key: str = "pair_id", model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """(key, precision, recall, f1) of a model over batches of (key, response, reference); all zero where there is no model."""
    if model is None:
        return pairs.select(key, *(F.lit(0.0).alias(m) for m in ("precision", "recall", "f1")))
    ship(pairs.sparkSession)
    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "response", "reference").mapInPandas(model, f"{key} {kind}, precision double, recall double, f1 double")


def rare_overlap(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, precision, recall, f1): greedy matching of words by their form, each weighted by its rarity among references.

    This is the published matching score with one-hot vectors in place of a
    model's: a word of a side counts wholly if the other side has it, and not
    at all otherwise; its weight is ln((references + 1) / (references with it + 1)).
    Words of a pair are counted within its row before they meet their weights. Null and empty
    texts score zero, and so do texts whose words are in every reference.
    """

    ship(pairs.sparkSession)
    theirs = F.array_distinct(F.filter(F.split(_plain("reference"), " "), lambda w: w != ""))
    known = scratch.table(pairs.select(F.explode_outer(theirs).alias("w")).where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("df")), "references")
    few = known.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return _rare_within_rows(pairs, key, {r["w"]: r["df"] for r in few}, pairs.count())

    @F.pandas_udf("array<struct<w:string,a:long,b:long>>")
    def counted(responses: pd.Series, references: pd.Series) -> pd.Series:
        sides = ((Counter(CUT(x)), Counter(CUT(y))) for x, y in zip(responses, references))
        return pd.Series([[{"w": w, "a": a.get(w), "b": b.get(w)} for w in a | b] for a, b in sides], dtype=object)

    total = pairs.agg(F.count(F.lit(1)).alias("n"))
    weight = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    counts = pairs.select(key, F.explode_outer(counted(_low("response"), _low("reference"))).alias("c")).where("c is not null").select(key, "c.*")
    met = counts.join(known, "w", "left").crossJoin(F.broadcast(total)).withColumn("weight", weight)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    share = lambda c: _ratio(F.sum(F.when(both, F.col(c) * F.col("weight")).otherwise(0.0)), F.sum(F.col(c) * F.col("weight")))
    sums = met.groupBy(key).agg(share("a").alias("precision"), share("b").alias("recall"))
    scored = pairs.select(key).join(sums, key, "left").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _rare_within_rows(pairs: DataFrame, key: str, known: dict[str, int], total: int) -> DataFrame:
    """``rare_overlap`` for few words of references, with how many have each: their weights go to every executor, and nothing is shuffled."""
    unknown = math.log(total + 1)
    weights = {w: math.log((total + 1) / (df + 1)) for w, df in known.items()}

    def share(own: Counter, other: Counter) -> float:
        each = [(w in other, n * weights.get(w, unknown)) for w, n in own.items()]
        whole = sum(x for _, x in each)
        return sum(x for both, x in each if both) / whole if whole else 0.0

    @F.pandas_udf("precision double, recall double")
    def run(responses: pd.Series, references: pd.Series) -> pd.DataFrame:
        sides = ((Counter(CUT(x)), Counter(CUT(y))) for x, y in zip(responses, references))
        return pd.DataFrame([(share(a, b), share(b, a)) for a, b in sides], columns=["precision", "recall"])

    scored = pairs.select(key, run(_low("response"), _low("reference")).alias("_s")).select(key, "_s.*")
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


#: What each level of accuracy comes with, and what each issue says.
ADVICE = {
    "HIGH": "Response demonstrates high legal information accuracy with proper case digest structure",
    "MEDIUM": "Response shows moderate legal information accuracy, consider improving section identification",
    "LOW": "Response has low legal information accuracy, significant improvements needed in case digest structure",
}
ISSUES = [
    "Content semantic similarity is low - response may not match reference meaning",
    "Information overlap is insufficient - ensure key facts are included",
    "Case digest section identification is poor - improve facts, issues, ruling structure",
    "Potential hallucination detected - verify factual consistency with reference",
]


def _places(c: Column, places: int = 4) -> Column:
    """Rounded to few places by way of twelve, so that the last bits of a quotient do not decide a half."""
    return F.round(F.round(c, 12), places)


def evaluated(pairs: DataFrame, key: str = "pair_id", model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """All scores of answers (key, query, response, reference): overlap, sections, departure, relevance, quality, level and issues.

    Sections of the content scores are all three; those of the quality follow from the question.
    ``semantic`` holds (key, f1) of likeness in meaning, ``rare_overlap`` for example; without it the model's scores are taken.
    """
    like = model_scores(pairs, key, model) if semantic is None else semantic
    overlaps = [_places(_scores(F.col("_w"), k)[2]).alias(name) for name, k in (("r1", 1), ("r2", 2), ("rl", "l"))]
    relevance = F.when(F.coalesce("query", F.lit("")) != "", query_relevance(F.col("query"), F.col("response"))).alias("relevance")
    read = pairs.select(key, "query", _words(pairs, 1, 2, "l").alias("_w"), relevance, present_sections(F.col("response")).alias("_ours"), present_sections(F.col("reference")).alias("_theirs"))
    digest, asked = (_compared(F.col("_ours"), F.col("_theirs"), expected_sections(q)).alias(name) for name, q in (("digest", F.lit("")), ("asked", F.col("query"))))
    # Scores alone meet: what is read of the texts is settled in their row.
    scores = read.select(key, *overlaps, "relevance", digest, asked).join(like.select(key, _places(F.col("f1")).alias("bert")), key)
    c = {n: F.col(n) for n in ("bert", "r1", "r2", "rl")}
    relevant = lambda r: composite_quality(*c.values(), F.col("asked.f1"), r)
    scores = scores.withColumns({"hallucination": hallucination(c["bert"], c["r1"]), "overall": _places(overall_relevance(*c.values(), F.col("digest.f1"))), "quality": F.when(F.col("relevance").isNull(), relevant(None)).otherwise(relevant(F.col("relevance")))})
    level = accuracy_level(F.col("quality"))
    met = [c["bert"] < 0.4, c["r1"] < 0.4, F.col("asked.f1") < 0.5, F.col("hallucination.detected")]
    issues = F.array_compact(F.array(*(F.when(m, t) for m, t in zip(met, ISSUES))))
    advice = F.element_at(F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair)), level)
    return scores.select(key, *c, F.col("digest.f1").alias("digest_f1"), "hallucination", "overall", _places(F.col("quality")).alias("accuracy_score"), level.alias("accuracy_level"), advice.alias("recommendation"), issues.alias("issues"), (F.col("quality") >= 0.65).alias("quality_threshold_met"))


def letters(pattern: str) -> str:
    """The longest run of letters that every match of a pattern of letters, blanks, gaps and letters that may be missing has."""
    return max(re.split(r"\\s\*|\.\*|.\?", pattern), key=len)


def section_scores(text: Column) -> Column:
    """Score of each section of a digest by name: 0.7 for its words, 0.3 for its patterns."""

    def scored(low: Column) -> Column:
        out = []
        for name, words in rules.DIGEST_WORDS.items():
            share = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) / float(len(words))
            patterns = rules.DIGEST_PATTERNS[name]
            # A pattern is tried only where its letters stand.
            found = sum(((F.contains(low, F.lit(letters(p))) & low.rlike(p)).cast("int") for p in patterns), F.lit(0)) / float(len(patterns))
            out += [F.lit(name), F.least(share, F.lit(1.0)) * 0.7 + found * 0.3]
        return F.create_map(*out)

    return let(F.lower(text), scored)


def present_sections(text: Column, least: float = 0.3) -> Column:
    """Sections that a text has."""
    return F.map_keys(F.map_filter(section_scores(text), lambda k, v: v > least))


def expected_sections(query: Column) -> Column:
    """Sections that a question asks for; all three unless it names some of them."""
    q = F.lower(F.coalesce(query, F.lit("")))
    has = lambda *w: sum((F.contains(q, F.lit(x)).cast("int") for x in w), F.lit(0)) > 0
    asked = F.array_compact(F.array(F.when(has("fact"), "facts"), F.when(has("issue"), "issues"), F.when(has("ruling", "decision", "held"), "ruling")))
    everything = F.array(F.lit("facts"), F.lit("issues"), F.lit("ruling"))
    digest = has("digest") | (has("covering") & has("main"))
    return F.when(digest | (F.size(asked) == 0), everything).otherwise(asked)


def compare_sections(response: Column, reference: Column, expected: Column) -> Column:
    """Accuracy, precision, recall and f1 of the expected sections, and which are missing or extra."""
    return _compared(present_sections(response), present_sections(reference), expected)


def _compared(ours: Column, theirs: Column, expected: Column) -> Column:
    """The same of the sections that both sides have."""
    ours, theirs = F.array_intersect(expected, ours), F.array_intersect(expected, theirs)
    hit = F.size(F.array_intersect(ours, theirs))
    p, r = _ratio(hit, F.size(ours)), _ratio(hit, F.size(theirs))
    missing, extra = F.array_except(theirs, ours), F.array_except(ours, theirs)
    accuracy = _ratio(F.size(expected) - F.size(missing) - F.size(extra), F.size(expected))
    return F.struct(_places(accuracy).alias("accuracy"), _places(p).alias("precision"), _places(r).alias("recall"), _places(f1(p, r)).alias("f1"), missing.alias("missing"), extra.alias("extra"))


def query_relevance(query: Column, response: Column) -> Column:
    """Share of the longer words of a question that the answer has, and up to 0.3 for related words."""
    words = F.array_distinct(F.filter(ascii_tokens(query, 1), lambda w: F.length(w) > 3))
    direct = F.size(F.array_intersect(words, ascii_tokens(response, 1)))
    related = F.create_map(*(x for k, v in rules.RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    bonus = let(F.lower(response), lambda low: F.size(F.filter(words, lambda w: F.coalesce(F.exists(F.try_element_at(related, w), lambda s: F.contains(low, s)), F.lit(False))))) * 0.5
    n = F.size(words)
    return F.when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), direct / n + F.least(bonus / n, F.lit(0.3))))


def context_relevance(query: Column, response: Column, context: Column) -> Column:
    """0.7 of the relevance, and 0.3 for the words of the question that context and answer share."""
    stop = F.array(*map(F.lit, rules.STOP_WORDS))
    words = lambda c: F.array_except(F.array_distinct(ascii_tokens(c, 1)), stop)
    shared = F.array_intersect(words(query), words(context))
    overlap = _ratio(F.size(F.array_intersect(shared, words(response))), F.size(shared))
    base = query_relevance(query, response)
    return F.when((F.coalesce(context, F.lit("")) == "") | (F.size(words(query)) == 0), base).otherwise(base * 0.7 + overlap * 0.3)


def hallucination(bert: Column, rouge: Column) -> Column:
    """Whether an answer departs from its reference, the score behind that, and how sure it is."""
    flag = (bert < BERT_FROM) | (rouge < ROUGE_FROM)
    above = F.least(F.lit(1.0), (bert - BERT_FROM) / (1 - BERT_FROM)) * 0.7 + F.least(F.lit(1.0), (rouge - ROUGE_FROM) / (1 - ROUGE_FROM)) * 0.3
    below = F.greatest(F.lit(0.0), (BERT_FROM - bert) / BERT_FROM) * 0.7 + F.greatest(F.lit(0.0), (ROUGE_FROM - rouge) / ROUGE_FROM) * 0.3
    return F.struct(flag.alias("detected"), _places(bert * 0.7 + rouge * 0.3).alias("consistency"), _places(F.when(flag, F.greatest(F.lit(0.0), 1 - below)).otherwise(above)).alias("confidence"))


def overall_relevance(bert: Column, rouge1: Column, rouge2: Column, rougel: Column, digest: Column) -> Column:
    """Weighted mean of the content scores."""
    return bert * 0.70 + (rouge1 + rouge2 + rougel) / 3 * 0.15 + digest * 0.15


def composite_quality(bert: Column, rouge1: Column, rouge2: Column, rougel: Column, digest: Column, relevance: Column | None) -> Column:
    """Weighted content, digest and relevance, raised as the published weights have it, within 0 and 1."""
    content = bert * 0.6 + rouge1 * 0.2 + rouge2 * 0.1 + rougel * 0.1
    mean = (content * 0.6 + digest * 0.2) / 0.8 if relevance is None else content * 0.6 + digest * 0.2 + relevance * 0.2
    raised = mean * 1.65
    raised = F.when(raised < 0.4, raised * 1.15).otherwise(raised)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raised))


def accuracy_level(score: Column) -> Column:
    """HIGH from 0.8, MEDIUM from 0.5."""
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def multilabel(pairs: DataFrame) -> DataFrame:
    """One row of metrics for (example, label, truth, guess) rows with 0/1 values; weighted by support."""
    t, g = F.col("truth"), F.col("guess")
    per = pairs.groupBy("label").agg(F.sum(t * g).alias("tp"), F.sum((1 - t) * g).alias("fp"), F.sum(t * (1 - g)).alias("fn"), F.sum((1 - t) * (1 - g)).alias("tn"))
    per = per.select("*", (F.col("tp") + F.col("fn")).alias("support"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"))
    per = per.withColumn("f", f1(F.col("p"), F.col("r")))
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    totals = per.agg(weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"), _ratio(F.sum("tn"), F.sum("tn") + F.sum("fp")).alias("specificity"))
    exact = pairs.groupBy("example").agg(F.min((t == g).cast("int")).alias("same")).agg(F.avg(F.col("same").cast("double")).alias("accuracy"))
    return totals.crossJoin(F.broadcast(exact))
