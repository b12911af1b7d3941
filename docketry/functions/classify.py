"""Classification of cases by keyword, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import automaton, rules
from docketry.functions.text import contains_any, first_present, let


def case_types(title: Column, text: Column, number: Column) -> Column:
    """The primary type of a case and its subtypes in the order of the rules."""
    words = list(dict.fromkeys([w for _, ws in rules.SUBTYPES for w in ws] + rules.CRIMINAL + ["A.M.", "PETITION"]))
    found = automaton.occurring(F.concat(F.upper(title), F.lit("\n"), F.upper(F.substring(text, 1, 4000))), words)
    both = F.struct(F.upper(title).alias("named"), found.alias("found"))
    return let(both, lambda b: _case_types(b["named"], b["found"], {w: k for k, w in enumerate(words)}, number))


def _case_types(named: Column, found: Column, place: dict[str, int], number: Column) -> Column:
    plain = ~contains_any(named, rules.NOT_ADMINISTRATIVE)
    both_sides = F.contains(named, F.lit("COMPLAINANT")) & F.contains(named, F.lit("RESPONDENT"))
    special = {"consolidated": F.contains(number, F.lit("-")), "administrative_matter": plain, "disciplinary_complaint": plain & both_sides}
    has = lambda *words: F.arrays_overlap(found, F.array(*(F.lit(place[w]) for w in words)))
    # The words of a rule as their places; a constant that a row is tested against, so that no code is generated for each.
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*(F.lit(place[w]) for w in words)).cast("array<int>").alias("words")) for label, words in rules.SUBTYPES))

    def met(rule: Column) -> Column:
        by_words = F.arrays_overlap(found, rule["words"])
        label = rule["label"]
        return F.when(label == "consolidated", special["consolidated"]).when(label == "administrative_matter", special["administrative_matter"] & by_words).when(label == "disciplinary_complaint", special["disciplinary_complaint"]).otherwise(by_words)

    listed = F.transform(F.filter(table, lambda r: F.coalesce(met(r), F.lit(False))), lambda r: r["label"])

    def whole(labels: Column) -> Column:
        unnamed = has("PETITION") & ~F.arrays_overlap(labels, F.array(*map(F.lit, rules.NAMED_PETITIONS)))
        return F.when(unnamed, F.array_append(labels, F.lit("petition"))).otherwise(labels)

    kind = F.when(has("A.M."), "administrative").when(has(*rules.CRIMINAL), "criminal").otherwise("civil")
    return F.struct(kind.alias("case_type"), let(listed, whole).alias("case_subtypes"))


def subject_counts(text: Column) -> Column:
    """(subject, rank, score) of every subject: how often its keywords stand in the text as whole ASCII words."""
    counts = automaton.counted(F.lower(text), rules.SUBJECTS)
    return let(counts, lambda n: F.array(*(F.struct(F.lit(s).alias("subject"), F.lit(k).alias("rank"), F.get(n, F.lit(k)).alias("score")) for k, s in enumerate(rules.SUBJECTS))))


def _scores(**by_label: Column) -> Column:
    """A map of the labels whose score is not null."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in by_label.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def by_rules(title: Column, text: Column, number: Column) -> Column:
    """Case type, jurisdiction and complexity with scores, and the best of them, without a model.

    A type scores a fifth for each of its words that text or title has, 1 at most; without any the case is civil.
    """
    t, title, number = (F.lower(F.coalesce(c, F.lit(""))) for c in (text, title, number))

    def whole(both: Column) -> Column:
        hits = {k: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(both["text"], w) | F.contains(both["title"], w))) for k, ws in rules.CASE_TYPE_WORDS.items()}
        kinds = _scores(**{k: F.when(n > 0, F.least(n / 5.0, F.lit(1.0))) for k, n in hits.items()})
        kinds = let(kinds, lambda m: F.when(F.size(m) > 0, m).otherwise(_scores(civil=F.lit(0.5))))
        supreme = F.when(F.contains(number, F.lit("g.r. no.")) | F.contains(number, F.lit("gr no")), 0.9).when(F.contains(number, F.lit("a.m.")), 0.8)
        court = _scores(supreme_court=supreme, regional_trial_court=F.when(supreme.isNull(), 0.6))
        n = F.length(both["text"])
        size = _scores(highly_complex=F.when(n > 10000, 0.8), complex=F.when((n > 5000) & (n <= 10000), 0.7), moderate=F.when((n > 2000) & (n <= 5000), 0.6), simple=F.when(n <= 2000, 0.7))
        told = F.struct(kinds.alias("case_type"), court.alias("jurisdiction_level"), size.alias("complexity_level"))
        best = lambda s: F.array_max(F.concat(*(F.map_values(s[k]) for k in ("case_type", "jurisdiction_level", "complexity_level"))))
        return let(told, lambda s: F.struct(F.lit("rule_based_fallback").alias("method"), s.alias("predictions"), best(s).alias("confidence")))

    return let(F.struct(t.alias("text"), title.alias("title")), whole)


def training_labels(title: Column, text: Column, case_type: Column, division: Column, special: Column, gr: Column, en_banc: Column) -> Column:
    """Labels for training in alphabetical order, from the fields of a case and words of its title and text; civil by default."""
    empty = F.array().cast("array<string>")
    named = lambda condition, *labels: F.when(condition, F.array(*map(F.lit, labels))).otherwise(empty)
    kind, bench = F.lower(case_type), F.lower(division)
    by_field = [
        F.when(kind.isin(rules.TYPE_LABELS), F.array(kind)).otherwise(empty),
        F.when(F.contains(bench, F.lit("first")), F.array(F.lit("supreme_court"))).when(F.contains(bench, F.lit("second")) | F.contains(bench, F.lit("third")), F.array(F.lit("appellate_court"))).otherwise(empty),
        named(F.contains(F.upper(special), F.lit("A.M.")), "administrative", "administrative_law"),
        named(F.coalesce(gr, F.lit("")) != "", "supreme_court"),
        named(en_banc, "constitutional_law"),
    ]
    full = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))))
    by_word = lambda t: F.concat(*(named(contains_any(t, words), *labels) for words, labels in rules.LABEL_WORDS))
    found = F.array_sort(F.array_distinct(F.concat(*by_field, let(full, by_word))))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("civil"))))


def subject_by_hints(title: Column, text: Column, number: Column) -> Column:
    """(primary, secondary) subject of a case that has no keyword of any."""
    both = F.lower(F.concat_ws(" ", title, text))

    def whole(t: Column) -> Column:
        pair = lambda first, second: F.struct(F.lit(first).alias("primary"), F.array(*map(F.lit, second)).cast("array<string>").alias("secondary"))
        out = F.when(F.contains(F.lower(F.coalesce(number, F.lit(""))), F.lit("a.m.")) | F.contains(t, F.lit("administrative matter")), pair("legal_ethics", ["political_law"]))
        for words, first, second in rules.SUBJECT_HINTS:
            out = out.when(contains_any(t, words), pair(first, second))
        return out.otherwise(F.struct(F.lit(None).cast("string").alias("primary"), F.array().cast("array<string>").alias("secondary")))

    return let(both, whole)


def subjects(title: Column, text: Column, number: Column) -> Column:
    """Primary and secondary subjects of a case, its scores by subject and how sure that is.

    Second are subjects with half the best score or more, best first; a case without any keyword goes by hints.
    """
    counts = F.filter(subject_counts(F.concat_ws(" ", title, text)), lambda s: s["score"] > 0)

    def whole(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda s: F.struct((-s["score"]).alias("below"), s["rank"].alias("rank"), s["subject"].alias("subject"))))
        best = F.array_max(F.transform(found, lambda s: s["score"]))
        second = F.transform(F.filter(F.slice(ranked, 2, len(rules.SUBJECTS)), lambda s: -s["below"] >= best * 0.5), lambda s: s["subject"])
        hints = subject_by_hints(title, text, number)
        some = F.size(found) > 0
        sure = F.when(best >= 10, "high").when(best >= 5, "medium").otherwise("low")
        scores = F.map_from_entries(F.transform(found, lambda s: F.struct(s["subject"].alias("key"), s["score"].alias("value"))))
        return F.struct(F.when(some, F.try_element_at(ranked, F.lit(1))["subject"]).otherwise(hints["primary"]).alias("primary"), F.when(some, second).otherwise(hints["secondary"]).alias("secondary"), scores.alias("scores"), sure.alias("confidence"))

    return let(counts, whole)


def picked_labels(predictions: Column, least: float = 0.1, most: int = 5, fallback: float = 0.01) -> Column:
    """Labels (label, score) above ``least``, best first; without any the ``most`` best above ``fallback``."""
    ranked = F.transform(F.array_sort(F.transform(predictions, lambda p: F.struct((-p["score"]).alias("below"), p["label"].alias("label")))), lambda p: F.struct(p["label"].alias("label"), (-p["below"]).alias("score")))

    def whole(r: Column) -> Column:
        sure = F.filter(r, lambda p: p["score"] > least)
        return F.when(F.size(sure) > 0, sure).otherwise(F.filter(F.slice(r, 1, most), lambda p: p["score"] > fallback))

    return let(ranked, whole)


def classified(case: DataFrame, now: Column | None = None) -> DataFrame:
    """``case`` with its classification by rules and what that was made from; the first of several field names that says something counts."""
    columns = {c.lower() for c in case.columns}
    first = lambda *names: F.coalesce(*(first_present(F.col(n)) for n in names if n in columns), F.lit(""))
    title, text, number = first("case_title", "title"), first("content", "clean_text", "body"), first("gr_number")
    made = F.struct(title.alias("case_title"), number.alias("gr_number"), F.length(text).alias("content_length"), F.unix_timestamp(F.current_timestamp() if now is None else now).alias("classification_timestamp"))
    return case.withColumn("classification", by_rules(title, text, number)).withColumn("input_metadata", made)
