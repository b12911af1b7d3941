"""The jobs against their SQL, on growing input, and run from the command line."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import library_feed, queries, retrieval_report

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(value):
    return round(value, 7) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_equal_to_sql(spark, name):
    sql = duckdb.connect()
    for table in ("documents", "benchmark"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got = queries.queries()[name](spark, FOLDER)
    assert before == before | {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    found = sql.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    expected = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == expected


def text(n, words=200):
    return " ".join(f"Word{n} number{k} of a document." for k in range(words))


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, library_feed.INPUT).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def state(spark, out):
    return sorted((tuple(r) for r in library_feed.current(spark, out).select("doc_id", "status", "first_id", "chunk_index", "chunk_id", "lang").collect()), key=repr)


def test_feed_takes_only_what_is_new(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, "a", [(1, text(1), "en"), (2, text(1), "fr"), (3, None, None), (4, "short", "en"), (5, text(5), None), (5, text(5), None)])
    library_feed.run(spark, f"{folder}/*", out, mark)
    first = state(spark, out)
    told = lambda rows: {(r[0], r[1], r[2]) for r in rows}
    assert told(first) == {(1, "new", 1), (2, "duplicate", 1), (3, "short", None), (4, "short", None), (5, "new", 5)}
    assert [r[3] for r in first if r[0] == 5] == list(range(len([r for r in first if r[0] == 5])))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    library_feed.run(spark, f"{folder}/*", out, mark)  # nothing new: nothing is written
    assert state(spark, out) == first and {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == files

    feed(spark, folder, "b", [(0, text(1), "en"), (6, text(6), "de"), (4, text(4), "en"), (1, text(7), "en")])
    library_feed.run(spark, f"{folder}/*", out, mark)
    assert told(state(spark, out)) == {(0, "duplicate", 1), (1, "new", 1), (2, "duplicate", 1), (3, "short", None), (4, "new", 4), (5, "new", 5), (6, "new", 6)}
    batches = spark.read.parquet(f"{out}/records").groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in batches] == [(0, 5), (1, 4)]
    assert {p: p.stat().st_mtime_ns for p in files} == files  # what the first batch wrote stays as it is


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, "a", [(1, text(1), "en"), (2, text(2), "fr")])
    library_feed.run(spark, f"{folder}/*", out, mark)
    feed(spark, folder, "b", [(3, text(1), "en"), (4, text(4), "fr")])
    real = library_feed.cut
    monkeypatch.setattr(library_feed, "cut", lambda *a: 1 / 0)  # after the records, before the chunks
    with pytest.raises(Exception):
        library_feed.run(spark, f"{folder}/*", out, mark)
    monkeypatch.setattr(library_feed, "cut", real)
    library_feed.run(spark, f"{folder}/*", out, mark)
    again = str(tmp_path / "whole")
    for part in ("a", "b"):
        shutil.copytree(tmp_path / "in" / part, tmp_path / "two" / part)
        library_feed.run(spark, f"{tmp_path}/two/*", again, f"{again}-mark")
    assert state(spark, out) == state(spark, again)


def test_reports_stand_side_by_side(spark, tmp_path):
    out, q = str(tmp_path / "out"), str(tmp_path / "q")
    docs = [(1, "alpha beta gamma delta", "en"), (2, "alpha beta", "fr"), (3, "zeta eta", None)]
    spark.createDataFrame(docs[:2], library_feed.INPUT).write.parquet(f"{tmp_path}/d1")
    spark.createDataFrame(docs, library_feed.INPUT).write.parquet(f"{tmp_path}/d2")
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "zeta eta theta"), (3, "!"), (4, None)], "item_id long, text string").write.parquet(q)
    retrieval_report.run(spark, f"{tmp_path}/d1", q, out, "first")
    retrieval_report.run(spark, f"{tmp_path}/d2", q, out, "second", "first")
    once = [sorted(map(tuple, t.collect()), key=repr) for t in retrieval_report.reports(spark, out)]
    hits, summary = retrieval_report.reports(spark, out)
    assert {tuple(r) for r in hits.where("run = 'second'").select("item_id", "rank", "doc_id", "met", "lang").collect()} == {(1, 1, 1, True, "en"), (1, 2, 2, True, "fr"), (2, 1, 3, True, None)}
    row = summary.where("run = 'second' and lang = 'all'").first()
    assert (row.questions, row.answered, row.hits, row.reciprocal_rank, row.on_target, row.against) == (4, 2, 3, 0.5, True, 0.25)
    assert {r.lang for r in summary.where("run = 'second'").collect()} == {"en", "fr", "none", "all"}
    retrieval_report.run(spark, f"{tmp_path}/d2", q, out, "second", "first")
    assert [sorted(map(tuple, t.collect()), key=repr) for t in retrieval_report.reports(spark, out)] == once
    retrieval_report.run(spark, f"{tmp_path}/d1", q, out, "second")  # what the run wrote before is gone
    assert hits.sparkSession.read.parquet(f"{out}/hits").where("run = 'second'").agg(F.max("doc_id")).first()[0] == 2
    with pytest.raises(ValueError):
        retrieval_report.run(spark, f"{tmp_path}/d1", q, out, "a/b")


def test_nothing_found(spark, tmp_path):
    spark.createDataFrame([], library_feed.INPUT).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    retrieval_report.run(spark, f"{tmp_path}/d", f"{tmp_path}/q", f"{tmp_path}/out", "none")
    hits, summary = retrieval_report.reports(spark, f"{tmp_path}/out")
    assert hits.count() == 0 and [tuple(r)[:4] for r in summary.collect()] == [("all", 1, 0, 0)]


def test_settings_are_checked(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"chunk_token": 5}')
    with pytest.raises(ValueError, match="chunk_token"):
        library_feed.run(spark, "nowhere", str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "s.json"))


@pytest.mark.parametrize("job", [library_feed, retrieval_report])
def test_command_lines(spark, tmp_path, monkeypatch, job):
    class Held:
        stop = staticmethod(lambda: None)

        def __getattr__(self, name):
            return getattr(spark, name)

    monkeypatch.setattr(job, "build", lambda master: Held())
    out = str(tmp_path / "out")
    given = [f"{FOLDER}/documents.parquet*", out, f"{out}-mark"] if job is library_feed else [f"{FOLDER}/documents.parquet", f"{FOLDER}/benchmark.parquet", out, "r1"]
    job.main(given)
    assert spark.read.parquet(f"{out}/{'records' if job is library_feed else 'hits'}").count() > 0
