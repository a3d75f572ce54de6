import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import compaction


def files(spark, payloads):
    return spark.createDataFrame([(p, i, "x") for i, p in enumerate(payloads)], "payload string, file_no int, line string")


def test_parse_records(spark):
    rec = json.dumps({"id": "a", "rev": 0, "body": "bé }{ [x]", "ups": 3})
    payloads = [
        "﻿" + rec + "\r\n\n" + '{"rev": 1, "id": "b", "extra": {"id": 9}}' + "\r" + '{"id":"c"}',
        None, "", "\n\n", "[1]\n\"x\"\n{bad}\n5", '{"id":""}\n{"rev":1}\n{"id":null}', '{"id":"cut","rev":0,"bo', '{"id":"d"}{"id":"e"}', '{"id":"f"} junk', '  {"id":"g","rev":2}  ',
    ]
    got = {(r.id, r.rev, r.body) for r in compaction.parse_records(files(spark, payloads)).collect()}
    assert got == {("a", 0, "bé }{ [x]"), ("b", 1, None), ("c", 0, None), ("g", 2, None)}


def test_parse_long_line(spark):
    line = json.dumps({"id": "long", "rev": 0, "body": "x" * 1_000_000})
    assert compaction.parse_records(files(spark, [line])).select(F.length("body")).first()[0] == 1_000_000


def test_clean_path(spark):
    df = spark.createDataFrame([("/a//b/./c/ ",), ("file:///a/b/c",), ("/a/b/c",), (None,)], "p string")
    assert [r[0] for r in df.select(compaction.clean_path(F.col("p"))).collect()] == ["/a/b/c", "/a/b/c", "/a/b/c", None]


def test_compact_once_each_sorted_and_swapped(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    rows = spark.range(5000).selectExpr("concat('i', id % 4000) id", "0 rev", "if(id % 3 = 0, null, 'hot') s", "sha2(cast(id % 4000 as string), 512) body")
    done = compaction.compact(rows, target, ["id", "rev"], ["s"], target_bytes=60_000)
    assert done.rows == 4000
    stored = spark.read.parquet(target)
    assert stored.count() == stored.select("id", "rev").distinct().count() == 4000
    sizes = [p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")]  # on disk, not as planned
    assert len(sizes) == done.files and 30_000 <= min(sizes) and max(sizes) <= 90_000
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name or "old" in p.name] == []
    compaction.compact(rows.limit(10), target, ["id", "rev"], ["s"])  # again, over the old folder
    assert spark.read.parquet(target).count() == 10


def test_compact_empty_and_failed_reconciliation(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/t"
    empty = spark.createDataFrame([], "id string, rev int, body string")
    assert compaction.compact(empty, target, ["id", "rev"], []).rows == 0
    assert spark.read.parquet(target).count() == 0
    rows = spark.createDataFrame([("a", 0, "x")], "id string, rev int, body string")
    monkeypatch.setattr(type(rows), "count", lambda self: 99)
    with pytest.raises(RuntimeError, match="nothing was swapped"):
        compaction.compact(rows, target, ["id", "rev"], [])
    monkeypatch.undo()
    assert spark.read.parquet(target).count() == 0


def test_small_files_of_a_tree(spark, tmp_path):
    base = f"file://{tmp_path}/in"
    rows = [(f"{base}/{k % 3}/{k}.jsonl", f'\ufeff{{"id": "i{k}", "body": "é"}}\r\n\r\nbroken\r{{"id": "same"}}' + ("" if k % 2 else '\n{"id": "cut", "bo')) for k in range(40)]
    rows += [(f"{base}/0/empty.jsonl", "")]
    assert spark.createDataFrame(rows, "path string, payload string").mapInArrow(compaction.write_each, "path string").count() == 41
    done = compaction.compact_files(spark, base, f"file://{tmp_path}/out", ["id", "rev"], ["subreddit"])
    assert done.rows == 41 and spark.read.parquet(done.target).filter("body = 'é'").count() == 40
    assert spark.conf.get("spark.sql.files.openCostInBytes") not in ("16384", str(16 << 10))


def test_an_interrupted_swap_is_put_right(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    compaction.compact(spark.createDataFrame([("a", 0)], "id string, rev int"), target, ["id", "rev"], [])
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert compaction.recover(spark, target) and not compaction.recover(spark, target)
    assert spark.read.parquet(target).count() == 1
