"""Case records of pages, titles of pages, and evaluation runs, by literal cases."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.operators import compose, evaluate
from docketry.sources import html

BODY = """<html><head><title>G.R. No. 176692 - Supreme Court E-Library</title><style>p {}</style></head><body><div>Home</div>
<div class="x single_content"><center><b>THIRD DIVISION</b></center>
<p>[ G.R. No. 176692, June 27, 2012 ]</p>
<p>MARIA REYES, PETITIONER, VS. COURT OF APPEALS, RESPONDENT.</p>
<p>D E C I S I O N</p><p>MENDOZA, J.:</p>
<p>THE FACTS</p><p>%s</p><p>THE ISSUE</p><p>%s</p><p>WHEREFORE, the petition for CERTIORARI is GRANTED.</p><p>SO ORDERED.</p></div></body></html>""" % ("It was so. " * 20, "Whether it was. " * 20)


def records(spark, pages, **hints):
    rows = spark.createDataFrame(pages, "url string, html string, year int, month string")
    return compose.from_pages(rows, year="year", month="month", now=F.timestamp_seconds(F.lit(0)))


def test_a_record_in_all_fields(spark):
    r = records(spark, [("http://h/showdocs/1/5", BODY, 2012, "june")]).first()
    assert r.id == "sha256:" + hashlib.sha256(b"http://h/showdocs/1/5").hexdigest()
    assert (r.gr_number, r.gr_numbers, r.special_number, r.special_numbers) == ("G.R. No. 176692", ["G.R. No. 176692"], None, None)
    assert r.case_title == r.shown_title == "MARIA REYES, PETITIONER, VS. COURT OF APPEALS, RESPONDENT."
    assert r.page_title == "G.R. No. 176692 - Supreme Court E-Library"
    assert (r.promulgation_date, r.promulgation_year, r.promulgation_month) == ("2012-06-27", 2012, "june")
    assert (r.court, r.clean_version, r.crawl_ts) == ("Supreme Court", "v2.2", "1970-01-01T00:00:00Z")
    assert (r.ponente, r.division, r.en_banc) == ("MENDOZA, J.", None, None)
    assert r.checksum == "sha256:" + hashlib.sha256(r.clean_text.encode()).hexdigest()
    assert "Home" not in r.clean_text and r.clean_text.startswith("[ G.R. No. 176692")
    assert set(r.sections) == {"ruling", "facts", "issues", "header"}
    assert r.sections["ruling"].startswith("WHEREFORE") and r.sections["ruling"].endswith("SO ORDERED.")
    assert "MARIA REYES" in r.sections["header"]
    assert (r.has_gr_number, r.has_special_number, r.case_type, r.case_subtype) == (True, False, "civil", "certiorari")
    assert r.quality_metrics.asDict() == {"has_ruling": True, "text_length": len(r.clean_text), "sections_extracted": 4, "has_structured_sections": True}


def test_records_of_odd_pages(spark):
    long = "<body><p>EN BANC</p><p>A.M. No. P-11-2907</p><p>" + "word " * 300 + "</p></body>"
    got = {r.source_url: r for r in records(spark, [("http://h/a", None, None, None), ("http://h/b", "", None, None), (None, long, 1999, None)]).collect()}
    assert got["http://h/a"].shown_title == "Untitled Case" and got["http://h/a"].clean_text == "" and got["http://h/a"].sections is None
    assert not got["http://h/b"].quality_metrics.has_structured_sections
    admin = got[None]
    assert (admin.special_number, admin.en_banc, admin.ponente, admin.case_type) == ("A.M. No. P-11-2907", True, "PER CURIAM", "administrative")
    assert records(spark, []).count() == 0


@pytest.mark.parametrize("page, title", [
    ("<h1>Cruz v. Reyes</h1><center>x</center>", "Cruz v. Reyes"), ("<h1>A title of some kind</h1>", "A title of some kind"),
    ("<h1>no</h1><center><b>EN BANC</b><br>Cruz versus Reyes<br>a much longer line than the caption is</center>", "Cruz versus Reyes"),
    ("<center>EN BANC</center><center>a first line<br>a longer second line</center>", "a longer second line"),
    ("<h2>Latest news of it</h2><h2>Ana versus Ben</h2>", "Ana versus Ben"), ("<p>one</p><p>a line of text</p>", "a line of text"),
    ('<p>outside versus here</p><div class="single_content"><p>inside</p></div>', "inside"),
    ("<title>Some long title | Site</title>", "Some long title"), ("<title>short</title>", None), ("", None), (None, None), ("<p>unclosed <b>Ana versus Ben", "Ana versus Ben"),
])
def test_titles_of_pages(page, title):
    assert html.title_of(page)[0] == title


@pytest.mark.parametrize("text, title", [("# Heading\nx", "Heading"), ("x\n## Second \n", "Second"), ("x\nAna versus Ben\n", "Ana versus Ben"), ("### third", None), (None, None)])
def test_titles_in_markdown(text, title):
    assert html.markdown_title(text) == title


def test_best_of_several_references(spark):
    rows = [(1, 1, 0.5, 0.2, 0.3), (1, 2, 0.1, 0.9, 0.3), (1, 3, 0.2, 0.2, 0.2), (2, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, ref int, precision double, recall double, f1 double")
    assert {tuple(r) for r in evaluate.best_reference(df, "k", "ref").collect()} == {(1, 0.5, 0.2, 0.3), (2, 0.0, 0.0, 0.0)}
    assert {tuple(r) for r in evaluate.best_components(df, "k").collect()} == {(1, 0.5, 0.9, 0.3), (2, 0.0, 0.0, 0.0)}


def test_an_evaluation_run(spark):
    text = "facts of the case: the petitioner and the respondent. issue: whether. ruling: we hold, the court ruled, it is hereby ordered, wherefore the decision is ordered, decreed, adjudged."
    pairs = spark.createDataFrame([(1, "a digest", text, text), (2, "", "nothing alike", text), (3, "the ruling", None, text)], "pair_id int, query string, response string, reference string")

    def perfect(batches):
        for b in batches:
            yield pd.DataFrame({"pair_id": b.pair_id, "precision": 1.0, "recall": 1.0, "f1": 1.0})

    got = {r.pair_id: r for r in evaluate.evaluated(pairs, model=perfect).collect()}
    assert len(got) == 3
    same = got[1]
    assert (same.r1, same.r2, same.rl, same.digest_f1, same.overall, same.accuracy_level) == (1.0, 1.0, 1.0, 1.0, 1.0, "HIGH")
    assert same.quality_threshold_met and same.issues == [] and not same.hallucination.detected
    assert got[2].hallucination.detected and evaluate.ISSUES[1] in got[2].issues and evaluate.ISSUES[0] not in got[2].issues
    without = {r.pair_id: r for r in evaluate.evaluated(pairs).collect()}
    assert without[1].bert == 0.0 and evaluate.ISSUES[0] in without[1].issues and without[1].recommendation == evaluate.ADVICE[without[1].accuracy_level]


def test_words_count_by_their_rarity(spark):
    rows = [(1, "A b.", "a b"), (2, "a c", "a d"), (3, None, "a"), (4, "a", "a x"), (5, "b b z", "a b y"), (6, "", None)]
    pairs = spark.createDataFrame(rows, "pair_id long, response string, reference string")
    b, y, z = math.log(7 / 3), math.log(7 / 2), math.log(7)
    a = math.log(7 / 6)
    got = {r.pair_id: (r.precision, r.recall) for r in evaluate.rare_overlap(pairs).collect()}
    want = {1: (1, 1), 2: (a / (a + z), a / (a + y)), 3: (0, 0), 4: (1, a / (a + y)), 5: (2 * b / (2 * b + z), b / (a + b + y)), 6: (0, 0)}
    assert got.keys() == want.keys()
    for k, found in got.items():
        assert found == pytest.approx(want[k])
    assert evaluate.rare_overlap(pairs.limit(0)).count() == 0


def test_scores_of_meaning_from_elsewhere(spark):
    text = "The facts and background: petitioner, respondent and accused. Issue: whether it was. Held and ordered, the decision and ruling."
    pairs = spark.createDataFrame([(1, "What was held?", text, text), (2, "", "nothing alike", text)], "pair_id long, query string, response string, reference string")
    got = {r.pair_id: r for r in evaluate.evaluated(pairs, semantic=evaluate.rare_overlap(pairs)).collect()}
    assert (got[1].r1, got[1].rl, got[1].accuracy_level) == (1.0, 1.0, "HIGH") and got[2].bert == 0.0
    assert got[2].hallucination.detected and len(got[2].issues) == 4


def test_references_without_an_end_are_text_where_sql_reads(spark):
    page = "<title>A&amp;&lt;B &amp;&amp &nbsp; &amp;lt; and more</title><h1>x</h1>"
    got = spark.createDataFrame([(page,)], "h string").select(html.read(html.closed_references(F.col("h"))).alias("t")).first()["t"]
    assert got["page_title"] == "A&<B &&amp &nbsp; &lt; and more"
    assert html.title_of(page)[1] == "A&<B && \u00a0 &lt; and more"


def test_overlaps_are_counted_within_the_row(spark):
    pairs = spark.createDataFrame([(1, "", "a b a c " * 300, "b a c c a"), (2, "", None, "a"), (3, "", "x", "")], "pair_id long, query string, response string, reference string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for scored in (evaluate.rouge_n(pairs, 1), evaluate.rouge_n(pairs, 2), evaluate.rouge_l(pairs), evaluate.best_components(evaluate.rouge_n(pairs, 1), "pair_id")):
        assert "Join" not in plan(scored)
    assert "FullOuter" not in plan(evaluate.rare_overlap(pairs)) and plan(evaluate.evaluated(pairs)).count("Join") == plan(pairs.join(pairs.select("pair_id"), "pair_id")).count("Join")
    hits = {n: [round(r.recall, 6) for r in evaluate.rouge_n(pairs, n).orderBy("pair_id").collect()] for n in (1, 2)}
    assert hits == {1: [1.0, 0.0, 0.0], 2: [0.75, 0.0, 0.0]}
    assert [r.recall for r in evaluate.rouge_l(pairs).orderBy("pair_id").collect()] == [1.0, 0.0, 0.0]
