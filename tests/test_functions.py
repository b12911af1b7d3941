"""Extractors and scores on literal inputs."""

import uuid

import pytest
from pyspark.sql import functions as F

from docketry.functions import display, extract, text
from docketry.operators import chunks, evaluate, glossary


def value(spark, column, **inputs):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()))
    return row.select(column.alias("out")).first().out


HEADERS = [
    ("[ G.R. No. 176692, June 27, 2012 ]", ["G.R. No. 176692"], "2012-06-27"),
    ("EN BANC\n[ G.R. Nos. 177857-58, January 24, 2012 ]", ["G.R. No. 177857-58"], "2012-01-24"),
    ("EN BANC [ A.M. No. P-11-2907, January 31, 2012 ]", [], "2012-01-31"),
    ("Promulgated: March 3, 2009", [], "2009-03-03"),
    ("[ no number, Foo 99, 2012 ] Decided on May 5, 2011", [], "2011-05-05"),
    ("nothing", [], None),
]


@pytest.mark.parametrize(("header", "numbers", "date"), HEADERS)
def test_header(spark, header, numbers, date):
    assert value(spark, extract.gr_numbers(F.col("t")), t=header) == numbers
    found = value(spark, extract.promulgation_date(F.col("t")), t=header)
    assert (found and found.isoformat()) == date


def test_special_numbers(spark):
    assert value(spark, extract.special_numbers(F.col("t")), t="A.C. No. 123 and A.M. No. P-11-2907; a.m. no. p-11-2907") == ["A.M. No. P-11-2907", "A.M. No. p-11-2907", "A.C. No. 123"]


@pytest.mark.parametrize(("t", "expected"), [("D E C I S I O N GESMUNDO, C.J.:", "GESMUNDO, C.J."), ("CARPIO MORALES, J.:", "CARPIO MORALES, J."), ("DELA CRUZ, J", "DELA CRUZ, J."), ("nobody", None)])
def test_ponente(spark, t, expected):
    assert value(spark, extract.ponente(F.col("t")), t=t) == expected


@pytest.mark.parametrize(("t", "expected"), [("x EN BANC y", "En Banc"), ("THIRD DIVISION", "Third Division"), (" " * 801 + "EN BANC", None)])
def test_division(spark, t, expected):
    assert value(spark, extract.division(F.col("t")), t=t) == expected


def test_sentences(spark):
    t = "In G.R. No. 123 the U.S. Court said so. THUS it ended well. Short. See 5 Phil. Reports for more."
    assert value(spark, text.sentences(F.col("t")), t=t) == ["In G.R. No. 123 the U.S. Court said so.", "THUS it ended well.", "See 5 Phil. Reports for more."]


def test_windows(spark):
    parts = [f"Sentence number {k} with some words in it to fill the window up." for k in range(200)]
    got = value(spark, chunks.windows(F.split(F.col("t"), r"\|"), 160, 24, 50), t="|".join(parts))
    tokens = lambda s: max(1, len(s) // 4)
    expected, held = [], []
    for s in parts:
        if held and sum(map(tokens, held)) + tokens(s) > 160:
            expected.append(" ".join(held))
            tail, n = [], 0
            for x in reversed(held):
                if n + tokens(x) > 24:
                    break
                tail.insert(0, x)
                n += tokens(x)
            held = tail
        held.append(s)
    expected.append(" ".join(held))
    assert got == [c for c in expected if tokens(c) >= 50]


def test_uuid(spark):
    for name in ("123_body_0", "é_ruling_4"):
        assert value(spark, text.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize(("t", "n"), [("", 0), ("abc", 1), ("a" * 9, 2)])
def test_token_estimate(spark, t, n):
    assert value(spark, text.token_estimate(F.col("t")), t=t) == n


def test_tokens_in_any_script(spark):
    assert value(spark, text.tokens(F.col("t")), t="Été, l'a_b c DÉJÀ-vu!") == ["été", "a_b", "déjà", "vu"]


@pytest.mark.parametrize(("q", "number"), [("G.R. NOS. 151809-12", "151809-12"), ("GR No. 0123456", "123456"), ("see 158088", "158088"), ("no number", None)])
def test_numbers_of_questions(spark, q, number):
    assert value(spark, extract.gr_of_query(F.col("q")), q=q) == number


def test_justices_of_questions(spark):
    assert value(spark, extract.ponente_of_query(F.col("q")), q="cases penned by Justice Lazaro-Javier") == "Lazaro-Javier"
    for doc, name, expected in [("LAZARO-JAVIER, J.", "Lazaro", True), ("SANTACRUZ, J.", "Cruz", True), ("PERALTA, J.", "Lazaro", False), ("", "Lazaro", False), ("DELA CRUZ, J.", "cruz dela", True)]:
        assert value(spark, extract.ponente_matches(F.col("d"), F.col("n")), d=doc, n=name) is expected


def test_parties(spark):
    assert value(spark, extract.parties(F.col("q")), q="Jehan vs. NFA") == ["jehan", "nfa"]
    assert value(spark, extract.parties(F.col("q")), q="annulment cases") == []
    assert value(spark, extract.asks_title(F.col("q")), q="jehan vs nfa") is True


def test_normalized(spark):
    assert value(spark, text.normalized(F.col("t")), t="a,\nb;\r\nc\nd\n\n\n\ne  f \\n g") == "a, b; c d\ne f g"


def test_site_lines(spark):
    t = "junk\nHOME\n[ G.R. No. 5, x ]\nHOME\n12 Phil. 34\nHOMEOWNERS win\n\n A+ \nend"
    assert value(spark, text.without_site_lines(F.col("t")), t=t) == "[ G.R. No. 5, x ]\nHOMEOWNERS win\nend"
    assert value(spark, text.without_site_lines(F.col("t"), compat=True), t=t) == "[ G.R. No. 5, x ]\nend"


def test_numbers_in_sentences_are_no_frame(spark):
    t = "call +1 (632) 555-4827 now\nMalaysia (632) 524-2706\n(632) 524-2706 \nend (632) 555-1111"
    assert value(spark, text.without_site_lines(F.col("t"), compat=True), t=t) == "call +1 (632) 555-4827 now\nend (632) 555-1111"


def test_display(spark):
    assert value(spark, display.site(F.col("u")), u="https://www.lawphil.net/a") == "LawPhil"
    assert value(spark, display.clean_response(F.col("t")), t="[INST] Based on my knowledge, x\n\n\n\ny However, please note that z") == "Based on my knowledge, x\n\ny"
    assert [r.role for r in value(spark, display.messages(F.col("t")), t="System: be brief\nUser: hello")] == ["system", "user"]
    assert value(spark, display.enhanced(F.col("q")), q="estafa") == "estafa Philippines law"


def test_rouge(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat ran fast"), (2, "", "x"), (3, "a b c d", "a c b d")], "pair_id long, response string, reference string")
    one = {r.pair_id: (round(r.precision, 4), round(r.recall, 4)) for r in evaluate.rouge_n(pairs, 1).collect()}
    assert one == {1: (0.6667, 0.5), 2: (0.0, 0.0), 3: (1.0, 1.0)}
    longest = {r.pair_id: round(r.f1, 4) for r in evaluate.rouge_l(pairs).collect()}
    assert longest == {1: 0.5714, 2: 0.0, 3: 0.75}


def test_levels_stay_within_bounds(spark):
    score = evaluate.composite_quality(*(F.lit(1.0) for _ in range(6)))
    assert value(spark, score, x=1) == 1.0
    assert value(spark, evaluate.composite_quality(*(F.lit(0.0) for _ in range(5)), None), x=1) == 0.0


def test_glossary(spark):
    entries = spark.createDataFrame(glossary.SEED, "term string, aliases array<string>, definition string, importance int")
    asked = spark.createDataFrame([(1, "swindling"), (2, "certiorary"), (3, "zzz")], "query_id long, query string")
    got = {r.query_id: (r.term, r.score) for r in glossary.search(entries, asked).where("rank = 1").collect()}
    assert got[1] == ("Estafa", 100.0) and got[2][0] == "Certiorari" and 3 not in got
