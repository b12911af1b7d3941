"""Rows by their place in files: slices, first records, questions of both forms of file."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import records


def whole(told):
    return told.where(F.col("value") != "")


@pytest.fixture
def folder(spark, tmp_path):
    """Five files with blank lines among 500 others; splits of a few lines each."""
    kept = [f"line {k} " + "x" * (k % 37) for k in range(500)]
    at = tmp_path / "files"
    at.mkdir()
    for n in range(5):
        (at / f"part-{n}.txt").write_text("".join(f"{t}\n\n" for t in kept[n * 100 : n * 100 + 100]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield str(at), kept
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("small", [True, False])
def test_slices(spark, folder, monkeypatch, small):
    path, kept = folder
    if not small:
        monkeypatch.setattr(records, "SLICE", 0)
    assert records.lines(spark, path).select("_file", "_start").distinct().count() > 5 * 5
    for first, last in ((1, 1), (98, 103), (1, 500), (490, 600), (501, 600)):
        got = records.sliced(spark, path, first, last, whole).collect()
        assert sorted((r.place, r.value) for r in got) == list(enumerate(kept, 1))[first - 1 : last]


def test_a_slice_reads_only_its_files(spark, folder):
    path, kept = folder
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # plans tell their filters in full
    try:
        got = records.sliced(spark, path, 205, 210, whole)
        assert sorted(r.value for r in got.collect()) == sorted(kept[204:210])
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = plan.split("DataFilters: ")[1].split("Format:")[0]
    assert "file_path" in scan and "/part-2.txt" in scan and "/part-1.txt" not in scan


def test_first_records_over_files(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for n in range(9):
        (at / f"f{n}.json").write_text("".join(f'{{broken\n\n{json.dumps({"id": f"{n}.{k}"})}\n' for k in range(3)))
    want = [f"{n}.{k}" for n in range(9) for k in range(3)]
    for n in (1, 12, 13, 27, 90):
        found = records.read_first(spark, str(at), n, "id string")
        assert [r.id for r in found.collect()] == want[:n]
    assert len(records.read_first(spark, str(at), 5, "id string").inputFiles()) == 4


def test_questions_of_both_forms(spark, tmp_path):
    asked = [{"query": f"q{k}", "category": "Case Digest", "case_year": "2001", "case_title": "T", "case_id": "A.C. No. 9"} for k in range(6)]
    (tmp_path / "one.json").write_text(json.dumps({"queries": asked}))
    (tmp_path / "lines.json").write_text("\n".join(["", "{oops", *map(json.dumps, asked)]))
    one = records.read_queries(spark, str(tmp_path / "one.json"), 2, 4)
    many = records.read_query_lines(spark, str(tmp_path / "lines.json"), 2, 4)
    assert one.columns == many.columns
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, one.collect())) and [r[0] for r in got] == [2, 3, 4] and {r[5] for r in got} == {"A.C. No. 9"}
    assert records.read_query_lines(spark, str(tmp_path / "lines.json"), 7, 9).count() == 0
