"""Running sums of groups of any size, and boxes within boxes."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.operators import search
from docketry.operators.running import running
from docketry.sources import pages


def test_running_sums(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["hot"] * 8 + ["a", "b", None]), n, pick.randint(0, 9), pick.random()) for n in range(4000)] + [("one", 5000, 3, 0.5)]
    df = spark.createDataFrame(rows, "g string, k int, v int, w double").repartition(7)
    w = Window.partitionBy("g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    want = {r.k: (r.g, r.v, r.s, round(r.t, 6)) for r in df.select("g", "k", "v", F.sum("v").over(w).alias("s"), F.sum("w").over(w).alias("t")).collect()}
    got = running(df, "g", [F.desc("k")], {"s": "v", "t": "w"})
    assert {r.k: (r.g, r.v, r.s, round(r.t, 6)) for r in got.collect()} == want and got.columns == ["g", "k", "v", "w", "s", "t"]
    assert running(df.where("false"), "g", [F.asc("k")], {"s": "v"}).count() == 0
    kept = search.within_budget(df, "v", 100, F.desc("k"), by="g")
    assert {r.k: r.running for r in kept.collect()} == {k: s for k, (_, _, s, _) in want.items() if s <= 100}


def test_no_window_holds_more_than_a_range_of_a_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), "id", F.lit(1).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges are not joined as too small
    try:
        out = running(df, "g", [F.asc("id")], {"s": "v"})
        assert out.where("s <> id + 1").count() == 0
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def inside(spark, html, box="b"):
    return spark.createDataFrame([(html,)], "h string").select(pages.within(F.col("h"), box)).first()[0]


def test_a_box_ends_where_it_closes(spark):
    assert inside(spark, '<div><div id="b"><div>1</div>2<div><div>3</div></div>4</div>5</div>') == "<div>1</div>2<div><div>3</div></div>4"
    assert inside(spark, "x<DIV class='k' id='b' y>1<Div>2</dIv >3</DIV>4") == "1<Div>2</dIv >3"
    assert inside(spark, '<div id="b">never <div>closed</div> at all') == "never <div>closed</div> at all"
    assert inside(spark, '<div id="b">1</div><div id="b">2</div>') == "1"
    assert inside(spark, '<div id="bb">1</div>') is None and inside(spark, None) is None and inside(spark, "") is None and inside(spark, '<div id="b"></div>') is None
    assert inside(spark, '<divider id="b">1</divider><div id="b">2\n3</div>') == "2\n3"
    page = '<a href="/0">0</a><div id="container_date"><div><h2>2010</h2><a href="/1">1</a></div><h2>2011</h2><a href="/2">2</a></div><a href="/3">3</a>'
    got = spark.createDataFrame([(page,)], "h string").select(pages.months(F.col("h"))).first()[0]
    assert [(m.year, m.url) for m in got] == [(2010, "/1"), (2011, "/2")]
