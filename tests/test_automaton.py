"""The automaton against plain searches."""

import random
import re

from pyspark.sql import functions as F

from docketry.functions import automaton, rules

WORDS = ("a", "ab", "aba", "b c", "c", "ba-b", "cab c", "_a")


def test_places_and_tallies_of_random_texts():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("abc -_é\n") for _ in range(draw.randrange(30)))
        assert automaton.places(text, WORDS) == [k for k, w in enumerate(WORDS) if w in text]
        assert automaton.tallies(text, WORDS) == [len(re.findall(rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])", text)) for w in WORDS]


def test_all_keywords_of_subjects():
    words = tuple(dict.fromkeys(w for ws in rules.SUBJECTS.values() for w in ws))
    text = " ".join(words) + "s"
    assert automaton.tallies(text, words) == [len(re.findall(rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])", text)) for w in words]


def test_columns_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "tax law, taxes"), (4, "x" * 200_000 + " tax")], "k int, t string")
    got = {r.k: (r.p, r.n) for r in df.select("k", automaton.occurring(F.col("t"), ["law", "tax"]).alias("p"), automaton.counted(F.col("t"), {"one": ["tax", "tax"], "two": ["law", "tax"], "none": []}).alias("n")).collect()}
    assert got == {1: (None, None), 2: ([], [0, 0, 0]), 3: ([0, 1], [1, 2, 0]), 4: ([1], [1, 1, 0])}
