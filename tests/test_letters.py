"""Patterns of sections are tried only where their letters stand, with the same scores."""

import re

from pyspark.sql import functions as F

from docketry.functions import rules
from docketry.operators import evaluate


def test_every_pattern_needs_its_letters(spark):
    patterns = [p for each in rules.DIGEST_PATTERNS.values() for p in each]
    for p in patterns:
        assert evaluate.letters(p).isalpha() and len(evaluate.letters(p)) >= 4
        assert re.fullmatch(r"(?:[a-z]\??|\\s\*|\.\*)+", p)
    texts = ["facts of the case", "fact ofthe\n case", "Antecedent FACTS", "issue presented", "wherefore it is ordered", "wherefore\nordered", "we  hold", "legalissues", "question for resolution", "", None, "factual case resolved"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    scored = df.select("k", evaluate.section_scores(F.col("t")).alias("s"))
    for r in scored.collect():
        low = texts[r.k].lower() if texts[r.k] is not None else None
        for name, words in rules.DIGEST_WORDS.items():
            if low is not None:
                found = sum(bool(re.search(p, low, re.A)) for p in rules.DIGEST_PATTERNS[name]) / len(rules.DIGEST_PATTERNS[name])
                assert abs(r.s[name] - (0.7 * sum(w in low for w in words) / len(words) + 0.3 * found)) < 1e-12
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Contains") >= len(patterns)


def test_words_of_scores_are_cut_in_one_pass(spark):
    rows = [(1, "A b_c  D2, é x", "a B c d2 X"), (2, None, ""), (3, "İstanbul KELVINK", "istanbul kelvink")]
    pairs = spark.createDataFrame(rows, "pair_id long, response string, reference string")
    scored = evaluate.rouge_n(pairs, 1)
    assert {r.pair_id: round(r.f1, 6) for r in scored.collect()}[1] == 1.0
    assert "regexp_replace" not in scored._jdf.queryExecution().optimizedPlan().toString()
