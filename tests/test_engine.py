"""Questions end to end, glossary files, the command line."""

import json

import pytest

from docketry.__main__ import main
from docketry.operators import engine, glossary


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (1, "ACME CORPORATION, PETITIONER, VS. NLRC", "G.R. No. 123456", None, "PERALTA, J.", "labor dispute over wages"),
        (2, "MARIA REYES VS. COURT OF APPEALS", "G.R. No. 200001", None, "LAZARO-JAVIER, J.", "annulment of marriage and property " * 5 + "WHEREFORE, granted. SO ORDERED."),
        (3, "PEDRO SANTOS VS. JUDGE LIM", None, "A.M. No. P-11-2907", "PERALTA, J.", "administrative complaint"),
        (4, "OTHER ANNULMENT CASE VS. SOMEONE", "G.R. No. 200001", None, None, "annulment again"),
        (5, "SOMETHING ELSE VS. NOBODY", "G.R. No. 5", None, None, "tax refund of a corporation"),
    ]
    return spark.createDataFrame(rows, "doc_id long, case_title string, gr_number string, special_number string, ponente string, clean_text string")


def test_answers(spark, cases):
    asked = ["G.R. No. 0123456 please", "A.M. No. P-11-2907 digest", "cases penned by justice Peralta", "acme vs nlrc", "annulment of marriage", "zebra vs giraffe tax"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in engine.answer(cases, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.route, r.doc_id))
    assert got[0] == [("number", 1)] and got[1] == [("special", 3)]
    assert got[2] == [("ponente", 1), ("ponente", 3)] and got[3] == [("title", 1)]
    assert got[4][0] == ("words", 4) and ("words", 2) not in got[4]  # one case of a number, the better titled
    assert got[5] == [("words", 5)]


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entries": [{"term": "Writ", "definition": "An order.", "aliases": ["order"]}, {"term": "Empty", "definition": ""}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"term": "Lien", "definition": "A claim.", "bar_importance": 5}]))
    (tmp_path / "c.json").write_text(json.dumps({"terms": ["x"]}))
    entries = glossary.read(spark, str(tmp_path / "*.json"))
    assert {r.term for r in glossary.names(entries).collect()} == {"Writ", "Lien"}
    assert glossary.read(spark, str(tmp_path / "c.json")).count() == len(glossary.SEED)


def test_command_line(capsys):
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main([]) == 2
