"""Windows kept as state: late rows, restarts, batches run again, odd rows."""

import datetime
import random

from docketry.streaming import kept

SCHEMA = "event_id long, ts timestamp, operation string, duration double"
START = datetime.datetime(2024, 3, 1)


def runs(spark, tmp_path, batches, keep, **options):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        keep(spark.readStream.schema(SCHEMA).parquet(source), sink, state, **options).awaitTermination()
    return sink


def drawn(seed, n, days):
    draw = random.Random(seed)
    return [(seed * 10_000 + k, START + datetime.timedelta(minutes=draw.randrange(days * 1440)), draw.choice(["a", "a", "a", "b", None]), draw.choice([1.0, 2.5, None])) for k in range(n)]


def test_last_rows_over_restarts(spark, tmp_path):
    batches = [drawn(2, 300, 40), drawn(1, 300, 60), [(None, START, "x", 1.0), (7, None, "x", 1.0)], [(5, START - datetime.timedelta(days=900), "late", 1.0)]]
    before = dict(spark.sparkContext.getConf().getAll()).get("spark.sql.streaming.stateStore.providerClass")
    sink = runs(spark, tmp_path, batches, kept.keep_last, most=50, shards=3)
    rows = [r for b in batches for r in b if r[0] is not None and r[1] is not None]
    want = sorted(rows, key=lambda r: (r[1], r[0]))[-50:]
    got = [(r.event_id, r.ts, r.operation, r.duration) for r in kept.last(spark, sink, 50).collect()]
    assert sorted(got, key=lambda r: (r[1], r[0])) == want
    assert spark.read.parquet(sink).count() <= 150  # the state of three shards
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before or before is None


def test_trailing_days_over_restarts(spark, tmp_path):
    late = [(5, START - datetime.timedelta(days=400), "late", 1.0), (6, START, "late", 4.0)]
    batches = [drawn(3, 300, 20), drawn(1, 300, 60), late, [(None, START, "x", 1.0), (7, None, "x", 1.0)]]
    sink = runs(spark, tmp_path, batches, kept.keep_days, days=50, shards=3)
    rows = [r for b in batches for r in b if r[0] is not None and r[1] is not None]
    newest = max(r[1] for r in rows).date()
    for days in (7, 50):
        want = {}
        for _, ts, operation, duration in rows:
            if (newest - ts.date()).days < days:
                n, total = want.get(operation, (0, 0.0))
                want[operation] = (n + 1, total + (duration or 0.0))
        got = {r.operation: (r.n, r.total) for r in kept.trailing(spark, sink, (7, 50)).where(f"days = {days}").collect()}
        assert got == want
