"""Sources, sinks and incremental loads."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import pages, records, tables
from docketry.streaming import incremental


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"id": "a", "gr_number": "G.R. No. 5", "sections": {"facts": "x"}}), "", "{broken", json.dumps({"id": "b", "gr_number": None})]
    with gzip.open(tmp_path / "cases.jsonl.gz", "wt") as out:
        out.write("\n".join(lines))
    got = records.read_cases(spark, str(tmp_path / "cases.jsonl.gz"))
    assert {r.id for r in got.collect()} == {"a", "b"}
    assert records.first_match(got, "5", F.asc("id")).first().id == "a"
    records.append_json(got, str(tmp_path / "out"))
    records.append_json(got, str(tmp_path / "out"))
    assert records.read_cases(spark, str(tmp_path / "out")).count() == 4


def test_newest_and_reports(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}.json").write_text(json.dumps([{"n": k}]))
    assert [r.n for r in records.newest(records.read_json_files(spark, str(tmp_path / "*.json"), "n int")).collect()] == [2]
    records.write_report(spark.createDataFrame([("q" * 300, 1)], "query string, n int"), str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "csv")).first().query) == 203


def test_pages(spark):
    html = '<title>Site | x</title><h2>2005</h2><a href="/m/1">Jan</a><a href="showdocs/2">d</a><h2>2006</h2><a href="http://o/3">Feb</a>'
    df = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    assert [r.url for r in pages.decision_links(df).collect()] == ["http://h/showdocs/2"]
    found = df.select(pages.months(F.col("html")).alias("m"), pages.title(F.col("html")).alias("t")).first()
    assert [(r.year, r.url) for r in found.m] == [(2005, "/m/1"), (2005, "showdocs/2"), (2006, "http://o/3")]
    assert found.t == "2005"


def test_restart_appends_nothing_twice(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id string, v int"
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    batch([("a", 1), ("a", 1), ("b", 1), (None, 9)])
    incremental.append_new(stream(), sink, state).awaitTermination()
    batch([("b", 2), ("c", 2)])
    incremental.append_new(stream(), sink, state).awaitTermination()
    incremental.append_new(stream(), sink, state).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_stream_upserts(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        spark.createDataFrame(rows, "id string, v int").write.mode("append").parquet(source)
        incremental.upsert_into(spark.readStream.schema("id string, v int").parquet(source), str(tmp_path / "t"), state, "id", "v").awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "batch=1")).collect()) == [("a", 2), ("b", 1)]


def test_stream_merges_only_touched_parts(spark, tmp_path):
    source, state, sink = (str(tmp_path / n) for n in ("in", "state", "t"))
    schema = "id string, v int"
    batches = [[(f"k{k}", 1) for k in range(40)] + [(None, 3)], [("k7", 2), ("k8", 0), ("k7", 1)], [("new", 5)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.merge_into(spark.readStream.schema(schema).parquet(source), sink, state, "id", "v", parts=8).awaitTermination()
    want = {f"k{k}": 1 for k in range(40)} | {"k7": 2, "new": 5, None: 3}
    assert {r.id: r.v for r in incremental.merged(spark, sink, parts=8).collect()} == want
    assert incremental.merged(spark, sink, parts=8).count() == len(want)
    assert len(list((tmp_path / "t" / "batch=2").glob("state_part=*"))) == 1
    # A batch that was not written whole does not count.
    (tmp_path / "t" / "batch=2" / "_SUCCESS").unlink()
    assert {r.id: r.v for r in incremental.merged(spark, sink, parts=8).collect()} == {k: v for k, v in want.items() if k != "new"}


def test_upsert_of_equal_versions(spark):
    schema = "id long, v int, text string, more map<string,string>"
    old = spark.createDataFrame([(1, 1, "old", None), (2, None, "old", None), (None, 1, "none", None)], schema)
    new = spark.createDataFrame([(1, 1, "new", {"a": "b"}), (2, 0, "new", None), (None, 2, "later", None)], schema)
    assert {r.id: (r.v, r.text) for r in records.upsert(old, new, "id", "v").collect()} == {1: (1, "new"), 2: (0, "new"), None: (2, "later")}
    assert records.upsert(old, new.limit(0), "id", "v").count() == 3


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 02:00:00", "view", 2.0), ("2024-01-05 00:00:00", "view", 4.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = incremental.run_once(incremental.operation_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "ops", str(tmp_path / "state"), "complete")
    assert sorted(r.total for r in out.collect()) == [3.0, 4.0]
    seen = incremental.new_records(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "event_type")
    assert incremental.run_once(seen, "kinds", str(tmp_path / "state2")).count() == 1


@pytest.mark.parametrize("n", [0, 3])
def test_upsert(spark, n):
    old = spark.createDataFrame([(k, 1) for k in range(n)], "id long, v int")
    new = spark.createDataFrame([(1, 2), (9, 2)], "id long, v int")
    got = {r.id: r.v for r in records.upsert(old, new, "id", "v").collect()}
    assert got[1] == 2 and got[9] == 2 and len(got) == {0: 2, 3: 4}[n]


def test_only_small_scans_are_spread(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    dealt = tables.spread(scan)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(100))
    monkeypatch.setattr(tables, "SMALL", 0)
    assert tables.spread(scan) is scan
