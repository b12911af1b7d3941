"""Classifiers and chunks: each rule by literal cases."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import classify, display, extract, titles
from docketry.operators import chunks, glossary, index, search
from docketry.sources import pages, records


def one(spark, column, **values):
    """The value of a column over one row of these strings."""
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("x",)], schema).select(column.alias("v")).first().v


def by_rules(spark, title, text, number):
    return one(spark, classify.by_rules(F.col("title"), F.col("text"), F.col("number")), title=title, text=text, number=number).asDict(recursive=True)


def test_rules_without_a_model(spark):
    theft = by_rules(spark, "People v. Cruz", "theft and robbery, a crime with a penalty of imprisonment, an offense", "G.R. No. 5")
    assert theft["predictions"] == {"case_type": {"criminal": 1.0}, "jurisdiction_level": {"supreme_court": 0.9}, "complexity_level": {"simple": 0.7}} and theft["confidence"] == 1.0
    plain = by_rules(spark, None, "xyz " * 600, None)
    assert plain["predictions"] == {"case_type": {"civil": 0.5}, "jurisdiction_level": {"regional_trial_court": 0.6}, "complexity_level": {"moderate": 0.6}} and plain["confidence"] == 0.6
    admin = by_rules(spark, "Breach", "government " + "x" * 6000, "A.M. No. P-1")
    assert admin["predictions"]["case_type"] == {"civil": 0.2, "administrative": 0.2} and admin["predictions"]["jurisdiction_level"] == {"supreme_court": 0.8}
    assert by_rules(spark, "", "x" * 10001, "GR No 1")["predictions"]["complexity_level"] == {"highly_complex": 0.8}
    assert by_rules(spark, "", "x" * 10000, "")["predictions"]["complexity_level"] == {"complex": 0.7}


@pytest.mark.parametrize("row, labels", [
    (("t", "x", None, None, None, None, None), ["civil"]),
    (("A felony", "x", "Criminal", "First Division", None, "G.R. No. 1", None), ["criminal", "criminal_law", "supreme_court"]),
    (("t", "breach of wage terms", "other", "Third Division", "a.m. no. 5", None, "true"), ["administrative", "administrative_law", "appellate_court", "civil", "civil_law", "constitutional_law", "labor", "labor_law"]),
    (("t", "the bill of rights", None, None, None, "", "false"), ["constitutional", "constitutional_law"]),
])
def test_labels_for_training(spark, row, labels):
    names = ["title", "text", "kind", "division", "special", "gr", "banc"]
    c = [F.col(n) for n in names[:-1]]
    assert one(spark, classify.training_labels(*c, F.col("banc").cast("boolean")), **dict(zip(names, row))) == labels


@pytest.mark.parametrize("title, text, number, expected", [
    ("", "tax tax tax vat vat labor union union", "", ("taxation_law", ["labor_law"], "medium")),
    ("X Corp.", "nothing of note", "", ("commercial_law", [], "low")),
    ("", "the seafarer of X Corp.", "", ("labor_law", [], "low")),
    ("", "zzz", "A.M. No. 4", ("legal_ethics", ["political_law"], "low")),
    ("", "a divorced couple", None, ("civil_law", [], "low")),
    ("", "zzz", None, (None, [], "low")),
    ("", "estafa " * 10, "", ("criminal_law", [], "high")),
    ("", "taxes vatican cross-claims", "", (None, [], "low")),
])
def test_subjects(spark, title, text, number, expected):
    s = one(spark, classify.subjects(F.col("title"), F.col("text"), F.col("number")), title=title, text=text, number=number)
    assert (s.primary, s.secondary, s.confidence) == expected


def test_picked_labels(spark):
    rows = [(1, [("a", 0.9), ("b", 0.2), ("c", 0.05)]), (2, [("a", 0.09), ("b", 0.02), ("c", 0.001)]), (3, [(chr(97 + k), 0.05) for k in range(9)])]
    got = spark.createDataFrame(rows, "k int, p array<struct<label:string,score:double>>").select("k", classify.picked_labels(F.col("p")).alias("p"))
    assert {r.k: [x.label for x in r.p] for r in got.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: list("abcde")}


CASE = "id string, gr_number string, special_number string, case_title string, ponente string, promulgation_date string, case_type string, case_subtypes array<string>, clean_text string, sections map<string,string>"


def test_chunks_of_a_whole_case(spark):
    sentence = "This sentence says something that is said here. "
    rows = [
        ("s1", "", "", "T", None, "2001-02-03", "civil", ["a", "b", "c", "d"], "WHEREFORE, it is granted. SO ORDERED.", None),
        ("s2", None, "A.M. No. 4", None, "X, J.", None, None, None, "text", {"Facts": " " + sentence * 120, "EMPTY": "  ", "Dispositive": "Granted."}),
        ("s3", "G.R. No. 3", None, "U", None, None, None, None, None, None),
    ]
    got = {}
    for r in chunks.case_chunks(spark.createDataFrame(rows, CASE)).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r)
    first = got["s1"][0]
    assert first.content == "Case: T. Date: 2001-02-03. Case Type: civil. Ruling: WHEREFORE, it is granted. SO ORDERED.. Legal Areas: a, b, c"
    assert (first.case_id, first.section, first.section_type, first.chunk_type, first.total_chunks) == ("s1", "summary", "mini_summary", "summary", 2)
    assert [(r.section, r.section_type, r.paragraph_index, r.chunk_index) for r in got["s1"][1:]] == [("ruling", "dispositive", 0, 1)]
    second = got["s2"]
    assert second[0].content == "Special Number: A.M. No. 4. Ponente: X, J." and second[0].case_id == "A.M. No. 4"
    assert sorted(r.section for r in second[1:]) == ["facts"] * (len(second) - 2) + ["ruling"] and len(second) > 3
    assert [r.content for r in second if r.section == "ruling"] == ["Granted."]
    assert [r.chunk_index for r in second] == list(range(len(second))) and {r.total_chunks for r in second} == {len(second)}
    assert [r.content for r in got["s3"]] == ["Case: U. G.R. Number: G.R. No. 3"]
    assert len({r.chunk_id for rs in got.values() for r in rs}) == sum(map(len, got.values()))
    assert chunks.case_chunks(spark.createDataFrame([], CASE)).count() == 0
    payload = chunks.payload(chunks.case_chunks(spark.createDataFrame(rows, CASE)))
    assert len(payload.schema["payload"].dataType.fields) == 24 and payload.count() == sum(map(len, got.values()))


@pytest.mark.parametrize("text, ponente", [
    ("D E C I S I O N GESMUNDO, C.J.:", "GESMUNDO, C.J."), ("x DELA CRUZ, J.: y", "DELA CRUZ, J."), ("REYES, JR., J.:", None),
    ("VELASCO JR., JJ., concur", "VELASCO JR., JJ."), ("VELASCO JR., J, x", "VELASCO JR., J."), ("CARPIO MORALES, J", "CARPIO MORALES, J."), ("nobody here", None),
])
def test_ponentes(spark, text, ponente):
    got = one(spark, extract.ponente(F.col("t")), t=text)
    assert got == ponente if ponente else got is None or got.endswith("J.")


def test_years(spark):
    rows = [(2010, None, True), (1999, "2010-01-01", False), (None, "2010-01-01", True), (None, "1999-01-01", False), (None, "undated", True), (None, None, True)]
    df = spark.createDataFrame(rows, "y int, d string, ok boolean")
    assert all(r.v == r.ok for r in df.select("ok", extract.within_years(F.col("y"), F.col("d"), 2005, 2015).alias("v")).collect())


@pytest.mark.parametrize("line, ok", [("A v. B", False), ("Cruz versus Reyes", True), ("EN BANC Cruz versus Reyes", False), ("People of the Philippines", True), ("no sides in it", False), ("x" * 3001 + " versus y", False)])
def test_title_like(spark, line, ok):
    assert one(spark, titles.title_like(F.col("t")), t=line) is ok


@pytest.mark.parametrize("text, number, title", [
    ("as in G.R. No. 123-4", "123-4", None), ("see gr no 55", "55", None), ("G.R. 77", "77", None),
    ("on **Ana Cruz vs. Ben Reyes**", None, None), ("on **Ana Cruz vs Ben Reyes** x", None, "Ana Cruz vs Ben Reyes"), ("**A v. B**", None, None), ("**Roe Inc. v. Wade Co.**", None, "Roe Inc. v. Wade Co."), ("nothing", None, None),
])
def test_case_in_a_message(spark, text, number, title):
    got = one(spark, display.case_in(F.col("t")), t=text)
    assert (got and (got.gr_number, got.case_title)) == ((number, title) if number or title else None)


def test_requests(spark):
    bodies = ['{"query": " a "}', '{"query": "  "}', '{"query": "a", "template_mode": "simplified", "history": [{"role": "user", "content": "x"}]}', '{"query": "a", "history": [{"role": "robot", "content": "x"}]}', '{"query": "a", "template_mode": "odd"}', "{}"]
    got = [r.v for r in spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").orderBy("k").select(display.request(F.col("b")).alias("v")).collect()]
    assert [(r.valid, r.template_mode, r.n_history) for r in got] == [(True, "full", 0), (False, "full", 0), (True, "simplified", 1), (False, "full", 1), (False, "odd", 0), (False, "full", 0)]


ENTRIES = [
    ("Amparo", ["writ of amparo"], "A remedy.", 5, ["one", "two"], [{"type": "rule", "id": "A.M. 07"}]),
    ("Rule 45", [], "Appeal by certiorari.", 3, None, None), ("Rule 65", [], "Certiorari proper.", 3, None, None), ("Forum shopping", [], "Several suits.", 4, ["same parties"], None),
]


@pytest.mark.parametrize("question, answer", [
    ("What is amparo?", "Amparo: A remedy.\nAnchors: rule: A.M. 07"), ("elements of forum shopping", "Forum shopping: Several suits.\nElements:\n- same parties"),
    ("tests of amparo.", "Amparo: A remedy.\nElements:\n- one\n- two\nAnchors: rule: A.M. 07"), ("ano ang writ of amparo", "Amparo: A remedy.\nAnchors: rule: A.M. 07"),
    ("Rule 45 vs 65", f"Rule 45: Appeal by certiorari.\nRule 65: Certiorari proper.\n{glossary.RULES_TOLD}"), ("What is the ruling in G.R. No. 211089?", None), ("People v. Dizon", None), ("hello", None), ("", None), ("define zzzzzz", None),
])
def test_responder(spark, question, answer):
    entries = spark.createDataFrame(ENTRIES, "term string, aliases array<string>, definition string, importance int, elements array<string>, anchors array<struct<type:string,id:string>>")
    got = glossary.respond(entries, spark.createDataFrame([(7, question)], "query_id int, query string")).collect()
    assert [(r.query_id, r.answer) for r in got] == [(7, answer)]


def test_likeness_is_asked_for_only_where_it_can_be(spark):
    entries = spark.createDataFrame([("certiorari", [], "d", 3), ("quo warranto", [], "d", 3)], "term string, aliases array<string>, definition string, importance int")
    asked = spark.createDataFrame([(0, "certiorary"), (1, "qou waranto"), (2, "zzzz")], "query_id int, query string")
    assert {(r.query_id, r.term) for r in glossary.search(entries, asked).collect()} == {(0, "certiorari"), (1, "quo warranto")}


def test_lookups_by_all_forms(spark):
    rows = [(k, f, v) for k, (f, ps) in enumerate(records.PREFIXES.items()) for v in [p + "77" for p in ps]]
    cases = spark.createDataFrame([(n, str(n) if f != "id" else v, v if f == "gr_number" else None, v if f == "special_number" else None) for n, (_, f, v) in enumerate(rows)], "n int, id string, gr_number string, special_number string")
    assert len(rows) == 19
    for n in range(len(rows)):
        assert records.first_match(cases.where(F.col("n") == n), "77", F.asc("n")).count() == 1
    got = records.first_matches(cases, spark.createDataFrame([(1, "77"), (2, "no")], "query_id int, number string"), "n").collect()
    assert [(r.query_id, r.n) for r in got] == [(1, 0)]


def test_index_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red red blue"), (2, None), (3, ""), (4, "blue"), (4, "blue sky")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red sky sky"), (2, ""), (3, "nothing known")], "query_id int, query string")
    index.build(docs, str(tmp_path / "a"))
    want = {(r.query_id, r.doc_id): round(r.score, 9) for r in search.bm25(docs, asked).collect()}
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in index.bm25(spark, str(tmp_path / "a"), asked).collect()} == want and {k for k in want} == {(1, 1), (1, 4)}
    index.build(docs.where("false"), str(tmp_path / "b"))
    assert index.bm25(spark, str(tmp_path / "b"), asked).count() == 0


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} other") for k in range(50)], "doc_id int, text string")
    asked = spark.createDataFrame([(k, f"word{k}") for k in range(7)], "query_id int, query string")
    want = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in search.bm25(docs, asked).collect())
    monkeypatch.setattr(search, "FEW", 2)
    monkeypatch.setattr(search.sized, "__defaults__", (2,))
    assert sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in search.bm25(docs, asked).collect()) == want


def test_months_within_the_list(spark):
    html = '<a href="/x">x</a><div id="container_date"><h2>2004</h2><a href="/m/1">Jan</a><h2> 2005</h2><a href="http://o/2">Feb</a></div><a href="/y">y</a>'
    got = one(spark, pages.months(F.col("h"), F.lit("http://h/p"), 2005, 2006), h=html)
    assert [(r.year, r.url) for r in got] == [(2005, "http://o/2")]
