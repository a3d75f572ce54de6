import threading

import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import bare_id
from loomspark.operators import delivery
from loomspark.operators.delivery import SeenRegistry

SCHEMA = "row_id string, note string, at int, ident string, seen string"


def admit(registry, spark, rows, token):
    batch = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    out = registry.admit(batch, bare_id(F.col("row_id")), [F.col("at")], token)
    return sorted((r.ident, r.note, r.arrivals) for r in out.collect())


def test_one_arrival_per_identifier_over_batches(spark, tmp_path):
    reg = SeenRegistry(spark, f"file://{tmp_path}/seen")
    first = admit(reg, spark, [("a", "late", 2, "x"), ("t1_A ", "early", 1, None), ("b", "b", 1, None), (None, "n", 1, None), ("", "e", 1, None), (" ", "s", 1, None)], "one")
    assert first == [("a", "early", 2), ("b", "b", 1)]
    assert admit(reg, spark, [("b", "again", 0, None), ("c", "c", 1, None)], "two") == [("c", "c", 1)]
    assert admit(reg, spark, [("a", "x", 0, None), ("c", "y", 1, None)], "three") == []
    assert admit(reg, spark, [("zzz", "other", 0, None)], "two") == [("c", "c", 1)]  # a repeated token gives its first result
    assert reg.bitmaps().agg(F.sum(F.bitmap_count("bits"))).first()[0] == 3
    codes = reg.dictionary().collect()
    assert len({(r.shard, r.code) for r in codes}) == len({r.ident for r in codes}) == 3
    assert {(r.ident, r.seen) for r in reg.decided("two").collect()} == {("b", True), ("c", False)}


def test_the_bit_decides(spark, tmp_path):
    """Queues share the dictionary: an identifier known from one is unseen in the other, until its bit there is set."""
    reg = SeenRegistry(spark, f"file://{tmp_path}/seen")
    batch = lambda rows: spark.createDataFrame(rows, "q string, i string")
    take = lambda rows, token: {(r.q, r.i) for r in reg.admit(batch(rows), F.col("i"), [F.col("i")], token, F.col("q")).collect()}
    assert take([("jobs", "a"), ("jobs", "b")], "1") == {("jobs", "a"), ("jobs", "b")}
    assert take([("results", "a"), ("jobs", "a"), ("results", "c")], "2") == {("results", "a"), ("results", "c")}
    assert reg.dictionary().count() == 3
    assert take([("results", "a"), ("results", "b"), ("jobs", "c"), (None, "a")], "3") == {("results", "b"), ("jobs", "c"), (None, "a")}
    # without its bitmaps the registry admits everything again, though the dictionary knows all identifiers
    reg._union = lambda commits: spark.createDataFrame([], delivery.BITMAPS)
    assert take([("jobs", "a"), ("results", "a")], "4") == {("jobs", "a"), ("results", "a")}


def test_many_identifiers_need_several_bitmaps(spark, tmp_path):
    reg = SeenRegistry(spark, f"file://{tmp_path}/seen")
    ids = spark.range(70_000).select(F.concat(F.lit("i"), "id").alias("row_id"), F.lit("n").alias("note"))
    assert reg.admit(ids, F.col("row_id"), [F.col("note")], "a").count() == 70_000
    more = spark.range(69_990, 70_005).select(F.concat(F.lit("i"), "id").alias("row_id"), F.lit("n").alias("note"))
    assert reg.admit(more, F.col("row_id"), [F.col("note")], "b").count() == 5
    assert reg.bitmaps().agg(F.sum(F.bitmap_count("bits"))).first()[0] == 70_005
    assert reg.bitmaps().count() >= 3


def test_ties_and_copies_and_empty(spark, tmp_path):
    reg = SeenRegistry(spark, f"file://{tmp_path}/seen")
    assert admit(reg, spark, [], "none") == []
    assert admit(reg, spark, [("k", "b", 1, None)] * 500 + [("k", "a", 1, None)], "tie") == [("k", "a", 501)]
    long = "x" * 100_000
    assert admit(reg, spark, [(long, long, 1, None)], "long")[0][0] == long


def test_generations_are_merged(spark, tmp_path):
    reg = SeenRegistry(spark, f"file://{tmp_path}/seen", merge_after=3)
    for k in range(4):
        assert admit(reg, spark, [(f"i{k}", "n", 1, None), ("same", "n", 1, None)], f"t{k}") == [(f"i{k}", "n", 1)] + ([("same", "n", 1)] if not k else [])
    assert len(reg._commits()[1]) <= 3 and reg.dictionary().count() == 5
    other = SeenRegistry(spark, f"file://{tmp_path}/seen")
    assert admit(other, spark, [("i0", "n", 1, None), ("new", "n", 1, None)], "t9") == [("new", "n", 1)]
    assert admit(other, spark, [("ignored", "n", 1, None)], "t1") == [("i1", "n", 1)]


def test_two_writers_at_once(spark, tmp_path):
    """Both decide on the same generation; every identifier still comes out exactly once."""
    path = f"file://{tmp_path}/seen"
    admit(SeenRegistry(spark, path), spark, [("old", "o", 1, None)], "zero")
    meet, out, failed = threading.Barrier(2), {}, []

    class Slow(SeenRegistry):
        waited = False

        def _publish(self, *a, **k):
            if not self.waited:  # both have written their data before either commits
                self.waited = True
                meet.wait(60)
            return super()._publish(*a, **k)

    def run(name):
        try:
            out[name] = admit(Slow(spark, path), spark, [("shared", name, 1, None), ("old", name, 1, None), (f"own-{name}", name, 1, None)], name)
        except Exception as e:  # pragma: no cover
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    handed = [i for rows in out.values() for i, _, _ in rows]
    assert sorted(handed) == ["own-x", "own-y", "shared"]
    codes = SeenRegistry(spark, path).dictionary()
    assert codes.count() == codes.select("ident").distinct().count() == 4


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/seen"

    class Dying(SeenRegistry):
        def _publish(self, *a, **k):
            raise OSError("gone")

    with pytest.raises(OSError):
        admit(Dying(spark, path), spark, [("a", "a", 1, None), ("b", "b", 1, None)], "one")
    assert admit(SeenRegistry(spark, path), spark, [("a", "a", 1, None), ("c", "c", 1, None)], "two") == [("a", "a", 1), ("c", "c", 1)]
    assert admit(SeenRegistry(spark, path), spark, [("a", "a", 1, None), ("b", "b", 1, None)], "one") == [("b", "b", 1)]


def test_two_writers_of_one_batch(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    late = SeenRegistry(spark, path)
    stale = late._commits()
    assert admit(SeenRegistry(spark, path), spark, [("a", "first", 1, None)], "same") == [("a", "first", 1)]
    real, late._commits = late._commits, lambda: (setattr(late, "_commits", real), stale)[1]
    assert admit(late, spark, [("a", "second", 1, None)], "same") == [("a", "first", 1)]
