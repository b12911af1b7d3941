"""Queries without SQL read the whole of their tables."""

import duckdb
import pytest

from docketry.plans import catalogue
from docketry.sources.tables import cases

TEXT = " ".join(f"Word{k} stands in sentence {k} of this text." for k in range(1500))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, TEXT, "en", "s") for k in (3, 4, 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def test_every_character_reaches_the_cases(spark, folder):
    for r in cases(spark, folder).collect():
        if r.doc_id % 3:
            assert TEXT in r.clean_text
        else:
            facts, rest = r.clean_text.split("THE FACTS\n")[1].split("\nTHE ISSUE\n")
            issue, rest = rest.split("\nTHE RULING\n")
            assert facts + issue + rest[: rest.rindex("\n")] == TEXT


def test_section_chunks_of_long_documents(spark, folder):
    rows = catalogue.queries()["section_chunks"](spark, folder).where("doc_id = 9").collect()
    assert sum(r.token_count for r in rows) >= len(TEXT) // 4


@pytest.fixture(scope="module")
def others(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("others"))
    spark.createDataFrame([(7, 3), (50, 0), (99, 12)], "vec_id long, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(k, f"u{k}") for k in (0, 4, 5, 9, 17)], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "one\n\ntwo"), (1, 1, "user", "one")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    long = " ".join(f"w{k}" for k in range(200))
    spark.createDataFrame([(1, f"{long} {long} tail")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_all_vectors_have_labels(spark, others):
    rows = catalogue.queries()["multi_hot"](spark, others).collect()
    assert len(rows) == 30
    assert {(r.vec_id, r.label_id) for r in rows if r.hot} == {(7, 3), (50, 0)}


def test_results_are_ranked_where_ids_are_missing(spark, others):
    rows = catalogue.queries()["web_answer"](spark, others).collect()
    assert {r.batch: r.answer for r in rows} == {0: "1. u0\n2. u4\n3. u5", 1: "1. u17"}


def test_whole_texts_are_compared(spark, others):
    row = catalogue.queries()["term_sets"](spark, others).first()
    assert row.n_both >= 195 and row.n_missing <= 5


def test_messages_with_empty_lines_are_cleaned(spark, others):
    rows = {r.turn: r.digest for r in catalogue.queries()["clean_response"](spark, others).collect()}
    assert set(rows) == {0, 1} and rows[0] != rows[1]


def test_important_chunks_of_every_case(spark, folder):
    rows = catalogue.queries()["important_section_chunks"](spark, folder).orderBy("doc_id", "n").collect()
    by_doc = {k: [r.section for r in rows if r.doc_id == k] for k in (3, 4, 9)}
    assert by_doc[3][0] == "issues" and by_doc[9][0] == "issues" and by_doc[4] == ["ruling"]
    assert all([r.n for r in rows if r.doc_id == k] == list(range(1, len(v) + 1)) and len(v) <= 5 for k, v in by_doc.items())
    assert {r.section_type for r in rows} <= {"dispositive", "issues", "legal_analysis"}


def test_parties_of_every_message_are_sought(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(k, "text", "en", "s") for k in range(120)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    asked = [
        (9, 0, "Maria Reyes vs. Court of Appeals 1"), (9, 1, "People of the Philippines\nVERSUS\n\u00a0Juan Cruz 6\u2009\n"), (9, 2, "Pedro Santos vs.Judge Lim 3"), (33, 0, "BIR vs Delta Co. vs NLRC"), (8, 5, "made anew"),
        (45, 0, "people vs c"), (45, 1, "vs NLRC 2"), (45, 2, None), (57, 0, "the text names no parties"), (57, 1, "vs"), (57, 2, "Maria Reyes vs " + "x" * 5000), (69, 0, "reyes, vs appeals versed"),
    ]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in asked], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["title_party_match"](spark, at).select("conv_id", "turn", "doc_id", "case_title").collect())
    numbered = lambda kind, start: {d for d in range(120) if d % 6 == kind and str(d % 50).startswith(str(start))}
    assert {(c, t): {d for a, b, d, _ in got if (a, b) == (c, t)} for c, t, _ in asked} == {
        (9, 0): numbered(1, 1), (9, 1): numbered(0, 6), (9, 2): numbered(3, 3), (33, 0): numbered(5, ""), (8, 5): numbered(2, 8), (45, 0): numbered(0, ""),
        (45, 1): set(), (45, 2): set(), (57, 0): set(), (57, 1): set(), (57, 2): set(), (69, 0): set(),
    }
    sql = duckdb.connect()
    for name in ("documents", "conversations"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    assert got == sorted(sql.execute(catalogue.oracle_sql()["title_party_match"]).fetchall())
