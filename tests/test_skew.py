import datetime as dt
import random
from collections import defaultdict

from loomspark.operators import skew

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "k string, at timestamp, v int, n int, slice int"


def brute(rows, gap=3600):
    groups = defaultdict(list)
    for k, at, v, *_ in rows:
        groups[k].append((at, v or 0))
    out = {}
    for k, items in groups.items():
        times = sorted(t for t, _ in items if t is not None)
        pauses = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        out[k] = (len(items), sum(v for _, v in items), times[0] if times else None, times[-1] if times else None, max(pauses, default=None), (1 if times else 0) + sum(p > gap for p in pauses))
    return out


def run(spark, rows, parts=5):
    got = skew.key_timelines(spark.createDataFrame(rows, SCHEMA), ["k"], "at", "v", parts, tie=["n"])
    utc = lambda t: t and t.astimezone(dt.timezone.utc)
    return {r.k: (r.n, r.total, utc(r.first_at), utc(r.last_at), r.max_gap_s, r.sessions) for r in got.collect()}


def test_heavy_key_null_keys_and_times(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None, ""]), None if rnd.random() < 0.05 else T0 + dt.timedelta(seconds=rnd.randrange(3_000_000)), rnd.choice([None, 1, 2]), i, 9) for i in range(3000)]
    rows += [("only-null", None, 4, 1, 1)]
    assert run(spark, rows) == brute(rows)


def test_ties_copies_and_empty(spark):
    rows = [("k", T0, 1, 0, 0)] * 50
    assert run(spark, rows) == {"k": (50, 50.0, T0, T0, 0.0, 1)}
    assert run(spark, []) == {}


def test_slices_share_a_heavy_key(spark):
    df = spark.range(20_000).selectExpr("'hot' as k", "id as o")
    sizes = skew.slices(df, ["k"], ["o"], 8).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert len([s for s in sizes if s > 1000]) >= 6


def test_heavy_keys(spark):
    counts = spark.createDataFrame([("c", "a", 96), ("c", "b", 4), ("d", None, 3)], "g string, k string, n int")
    assert {(r.g, r.k) for r in skew.heavy_keys(counts, "g", 0.04).collect()} == {("c", "a"), ("c", "b"), ("d", None)}


def test_lookup_with_heavy_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2), ("gone", 3)], "k string, i int")
    table = spark.createDataFrame([("hot", 300, "H"), ("cold", 1, "C"), ("idle", 0, "I")], "k string, load long, v string")
    for heavy in (100, 10_000):
        got = skew.lookup(rows, table, "k", heavy_rows=heavy).groupBy("k", "v").count().collect()
        assert {tuple(r) for r in got} == {("hot", "H", 300), ("cold", "C", 1)}
    assert skew.lookup(rows, table.limit(0), "k").count() == 0
