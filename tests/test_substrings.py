"""Joins of strings by shared runs against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketry.operators import search, substrings


def strings(seed, n, alphabet, longest):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest))) for _ in range(n)]


def test_containing(spark):
    large = strings(1, 60, "abcé 🎉", 30) + ["", None, "a" * 50_000 + "b"]
    small = strings(2, 80, "abcé 🎉", 5) + ["", None, "aab", large[3], "a" * 49_999 + "b"]
    big = spark.createDataFrame(list(enumerate(large)), "large_id int, text string")
    parts = spark.createDataFrame(list(enumerate(small)), "small_id int, part string")
    got = {(r.large_id, r.small_id) for r in substrings.containing(big, parts).collect()}
    assert got == {(k, n) for k, t in enumerate(large) for n, p in enumerate(small) if t and p and p in t}


@pytest.mark.parametrize("alphabet, longest", [("ab", 9), ("abcdefgh ", 14), ("abcdefghijklmnop ", 40)])
def test_alike_loses_no_pair(spark, alphabet, longest):
    pick = random.Random(longest)
    left = strings(3, 120, alphabet, longest)

    def changed(s):
        s = list(s)
        for _ in range(pick.randint(0, 1 + len(s) // 4)):
            at = pick.randint(0, len(s))
            s[at : at + pick.randint(0, 1)] = pick.choice(["", pick.choice(alphabet), "xy"])
        return "".join(s)

    right = [changed(s) for s in left] + ["", None]
    a = spark.createDataFrame(list(enumerate(left)), "left_id int, a string")
    b = spark.createDataFrame(list(enumerate(right)), "right_id int, b string")
    got = {(r.left_id, r.right_id): r.ratio for r in substrings.alike(a, b, 0.72).collect()}
    want = {(i, j): r for i, x in enumerate(left) for j, y in enumerate(right) if x and y and (r := SequenceMatcher(a=x, b=y).ratio()) >= 0.72}
    assert got == want
    if longest == 40:  # the filters leave a small part of all pairs
        assert substrings.candidates(a, b, 0.72).count() < len(left) * len(right) / 10


def test_titles_that_name_all_parties(spark):
    titles = [(1, "ACME CORP. VS. NLRC"), (2, "Acme Corp vs. Someone"), (3, None), (4, "NLRC V. ACME"), (5, "ACME CORP. VS. NLRC")]
    asked = [(1, ["acme", "nlrc"]), (2, ["acme corp", "someone"]), (3, ["acme"]), (4, ["acme", "acme"]), (5, None), (6, ["", "nlrc"])]
    got = search.named_in_titles(spark.createDataFrame(titles, "doc_id int, case_title string"), spark.createDataFrame(asked, "query_id int, parties array<string>"))
    assert {(r.query_id, r.doc_id) for r in got.collect()} == {(1, 1), (1, 4), (1, 5), (2, 2), (4, 1), (4, 2), (4, 4), (4, 5)}
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_first_titles_of_each_question(spark):
    titles = [(n, f"ACME VS. NLRC {n % 3}") for n in range(30)] + [(30, None), (31, "NLRC")]
    asked = [(q, ["acme", f"nlrc {q % 4}"] if q % 2 else [f"nlrc {q % 4}", "acme", "acme"]) for q in range(12)] + [(12, ["acme"]), (13, None)]
    made = lambda **k: {tuple(r)[:2] for r in search.named_in_titles(spark.createDataFrame(titles, "doc_id int, case_title string"), spark.createDataFrame(asked, "query_id int, parties array<string>"), **k).collect()}
    every = {(q, n) for q in range(12) for n in range(30) if n % 3 == q % 4}
    assert made() == every
    assert made(first=4) == {(q, n) for q, n in every if n < 12}


def test_parts_longer_than_every_string_are_not_cut(spark, monkeypatch):
    cut = []
    whole = F.udf(lambda t: cut.append(1) or [t[k : k + 3] for k in range(len(t) - 2)], "array<string>")
    monkeypatch.setattr(substrings, "runs", lambda c, size: F.when(F.length(c) > 20, F.raise_error(F.lit("cut"))).otherwise(whole(c)).cast("array<string>") if size == 3 else F.array().cast("array<string>"))
    big = spark.createDataFrame([(1, "maria reyes"), (2, "juan")], "large_id int, text string")
    parts = spark.createDataFrame([(1, "reyes"), (2, "x" * 50), (3, "maria reyess")], "small_id int, part string")
    assert {tuple(r) for r in substrings.containing(big, parts).collect()} == {(1, 1)}
