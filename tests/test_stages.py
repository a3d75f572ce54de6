import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import chains, density, inference, relations, rollups, search, writeback
from loomspark.sources import sinks, tables

MSG = "id string, parent_id string, link_id string, subreddit string, body string, ups int, downs int, is_idea boolean"


def test_complete_ideas_follow_the_code(spark):
    rows = [("A", None), ("B", "t1_A"), ("C", "t1_999"), ("D", "t1_C"), ("E", "t1_zz"), ("F", "t1_E"), ("G", "t1_H"), ("H", "t1_G"), ("I", "t1_G"), ("J", ""), ("B", "t1_A")]
    rows += [(f"n{i}", f"t1_n{i - 1}" if i else None) for i in range(150)]
    df = spark.createDataFrame([(i, p, "l", "s", "x", 1, 1, True) for i, p in rows] + [("K", "t1_A", "l", "other", "x", 1, 1, True)], MSG)
    got = {r.id for r in chains.complete_ideas(df).collect()}
    assert got == {"A", "B", "J"} | {f"n{i}" for i in range(150)}


def test_threads(spark):
    rows = [("a", None, "l", "s", "root", 2, None, True), ("b", "t1_a", "l", "s", "mid", None, 1, False), ("c", "t1_b", "l", "s", "leaf", 4, 1, True), ("x", "t1_no", "l", "s", "x", 1, 1, True)]
    rows += [(f"d{i:03}", f"t1_d{i - 1:03}" if i else None, "l", "s", "d", 1, 0, True) for i in range(103)]
    df = spark.createDataFrame(rows, MSG)
    got = {r.start_id: r for r in chains.threads(df, df.filter("is_idea")).collect()}
    assert got["c"].full_thread_body == "root\n\n---\n\nmid\n\n---\n\nleaf"
    assert (got["c"].total_ups, got["c"].avg_ups, got["c"].total_downs, got["c"].avg_downs) == (6, 2.0, 2, pytest.approx(2 / 3))
    assert got["a"].avg_downs == 0 and "x" not in got and "d100" in got and "d101" not in got


def test_nested_set(spark):
    df = spark.createDataFrame([(1, 1, 20_000), (2, 2, 5), (3, 3, 4), (4, 6, 9_000)], "id int, _lft int, _rgt int")
    assert {tuple(r) for r in chains.nested_set(df).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3)}


def test_write_back(spark):
    m = spark.createDataFrame([("1", True, 0.5), ("2", True, None), ("3", True, 0.1), ("4", False, None), (None, True, None)], "id string, is_idea boolean, nlp_top_score float")
    r = spark.createDataFrame([("1", "pain_point", 0.9), ("2", "idea", float("nan")), ("2", "idea", float("nan")), ("4", None, 0.3), (None, "idea", 1.0)], "row_id string, nlp_label string, nlp_score float")
    got = {x.id: (x.is_idea, None if x.nlp_top_score is None else round(x.nlp_top_score, 4)) for x in writeback.write_back(m, r).collect()}
    assert got == {"1": (False, 0.9), "2": (True, 0.0), "3": (True, 0.1), "4": (False, 0.3), None: (True, None)}
    assert {x.id: x.is_idea for x in writeback.write_back(m, r, reset=False).collect()}["1"] is True
    assert writeback.write_back(m, r).count() == 5
    assert writeback.id_status(m.limit(0).select("id"), m).first().status == 0


def test_merge_plans(spark):
    plans = spark.createDataFrame([("s", 1, "t1"), ("s2", 1, "t2")], "subreddit string, cluster_id int, title string")
    ideas = spark.createDataFrame([("s", 1, "i1"), (None, 1, "i3")], "subreddit string, cluster_id int, title string")
    assert [tuple(r) for r in writeback.merge_plans(plans, ideas, ["subreddit", "cluster_id"]).collect()] == [("s", 1, "t1", "i1")]


def test_rollups(spark):
    df = spark.createDataFrame([(1, "b", "two", 3, None), (1, "a", "one", None, None), (2, "c", None, None, None), (-1, "n", "noise", 9, 1)], "cluster_id int, id string, body string, ups int, downs int")
    got = {r.cluster_id: r for r in rollups.cluster_rollup(df, ["cluster_id"]).collect()}
    assert set(got) == {1, 2} and got[1].texts == ["one", "two"] and got[1].message_ids == ["a", "b"] and (got[1].total_ups, got[2].total_ups, got[1].total_downs) == (3, 0, 0)
    opp = {r.cluster_id: r for r in rollups.opportunities(df, ["cluster_id"], first=1).collect()}
    assert opp[1].representative_texts == ["one"] and (opp[1].cluster_size, opp[1].avg_quality_score, opp[2].avg_quality_score) == (2, 3.0, 0.0)
    assert rollups.cluster_rollup(df.limit(0), ["cluster_id"]).count() == 0
    many = spark.range(95).selectExpr("if(id < 90, 1, 2) as cluster_id", "cast(id as string) as id", "'t' as body", "1 as ups")
    parts = rollups.cluster_rollup(many, ["cluster_id"], part_rows=20).collect()
    assert len(parts) == 6 and max(len(r.texts) for r in parts) < 40 and sorted(i for r in parts for i in r.message_ids) == sorted(str(i) for i in range(95))
    assert tuple(rollups.cluster_stats(df).first()) == (2, 1)
    texts = spark.createDataFrame([(1, "build 3 " + "x" * 300), (1, "nothing"), (2, None)], "cluster_id int, body string")
    # mean length 157 (0), half with figures (2), half with action words (3)
    assert {r.cluster_id: r.quality for r in rollups.cluster_quality(texts, ["cluster_id"], "body").collect()} == {1: 5, 2: 0}


def test_dbscan_blobs(spark):
    rng = np.random.default_rng(0)
    pts = [(i, list(rng.normal(0, 0.05, 3))) for i in range(20)] + [(100 + i, list(5 + rng.normal(0, 0.05, 3))) for i in range(15)] + [(900, [99.0, 99, 99]), (901, None)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in pts], "vec_id int, v array<float>")
    got = {r.id: r.cluster_id for r in density.dbscan(df, "vec_id", "v", 0.5, 3).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[100 + i] for i in range(15)} == {100} and got[900] == got[901] == -1
    assert density.dbscan(df.limit(0), "vec_id", "v").count() == 0
    # one ring of cores, cut into blocks, with a border row
    ring = [(i, [float(np.cos(i / 20 * np.pi)), float(np.sin(i / 20 * np.pi))]) for i in range(40)] + [(77, [1.2, 0.0])]
    df = spark.createDataFrame(ring, "vec_id int, v array<float>")
    for anchors, block in ((1, 7), (8, 11), (1, 1000)):
        assert {r.cluster_id for r in density.dbscan(df, "vec_id", "v", 0.21, 3, anchors, block).collect()} == {0}


def test_close_pairs_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "i int, v array<float>")
    got = {(r.a, r.b) for r in density.close_pairs(df, "i", "v", 0.8, anchors=9).collect()}
    assert got == {(r.a, r.b) for r in density.close_pairs(df, "i", "v", 0.8, anchors=3, block_rows=40).collect()}
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if d[a, b] <= 0.8}


@pytest.mark.parametrize("method", ["leaf", "eom"])
def test_hdbscan_blobs(method):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(4, 0.1, (25, 2)), [[50.0, 50]]])
    labels = density.hdbscan_labels(x, 5, 3, "eom")
    assert len(set(labels[:30])) == 1 and len(set(labels[30:55])) == 1 and labels[0] != labels[30] and labels[55] == -1
    assert set(density.hdbscan_labels(x, 5, 3, method)) >= {0, 1}
    assert list(density.hdbscan_labels(x[:3], 5)) == [-1] * 3


def test_components_by_either_way(spark):
    """A hub, a chain and a loop; strings sort as strings."""
    links = [("hub", f"h{i}") for i in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "x")]
    df = spark.createDataFrame(links, "a string, b string")
    want = {"hub": "h0", "x": "x", "s": "s"} | {f"h{i}": "h0" for i in range(60)} | {f"c{i:03}": "c000" for i in range(71)} | {"y": "x", "z": "x"}
    for together, heavy in ((1_000, 100_000), (0, 100_000), (0, 10)):
        assert {r.node: r.label for r in density.components(df, together, heavy).collect()} == want
    assert density.components(df.limit(0)).count() == 0 and density.components(df.limit(0), 0).count() == 0


def test_hdbscan_of_large_groups(spark):
    """Groups cut into blocks have the clusters of the whole matrix."""
    rng = np.random.default_rng(4)
    blobs = np.vstack([rng.normal(c, 0.15, (40, 3)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (25, 3))])
    rows = [("big", i, [float(t) for t in v]) for i, v in enumerate(blobs)] + [(None, i, [float(t) for t in v]) for i, v in enumerate(blobs[::-1])]
    rows += [("big", 900, None), ("few", 1, [0.0, 0.0, 0.0]), ("few", 2, None)]
    df = spark.createDataFrame(rows, "g string, id int, v array<float>")
    whole = {(r.g, r.id): r.cluster_id for r in density.hdbscan(df, "g", "id", "v").collect()}
    cut = {(r.g, r.id): r.cluster_id for r in density.hdbscan(df, "g", "id", "v", together=50, block_rows=40).collect()}
    assert set(whole) == set(cut) and len(cut) == len(rows)
    same = {}
    for key, label in whole.items():
        same.setdefault((key[0], label), set()).add(cut[key])
    assert all(len(s) == 1 for s in same.values()) and len({v for k, v in cut.items() if k[0] == "big"}) >= 4
    assert {k for k, v in whole.items() if v == -1} == {k for k, v in cut.items() if v == -1}


@pytest.mark.parametrize("method", ["leaf", "eom"])
def test_hdbscan_of_large_groups_with_copies(spark, method):
    """Rows of equal vectors, also of 0 and -0, are one point with a weight; the clusters are those of the whole matrix."""
    rng = np.random.default_rng(6)
    places = np.vstack([rng.normal(c, 0.3, (30, 2)) for c in (0, 4)] + [rng.uniform(-3, 9, (15, 2)), [[20.0, 20.0], [0.0, 0.0]]])
    times = [*rng.integers(1, 5, 75), 2, 9]
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(np.repeat(places, times, axis=0))] + [(1000, [-0.0, 0.0])]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id int, v array<double>")
    whole = density.hdbscan_labels(np.array([v for _, v in rows]), 5, 3, method)
    cut = {r.id: r.cluster_id for r in density.hdbscan(df, "g", "id", "v", together=50, block_rows=20, method=method).collect()}
    assert len(cut) == len(rows) and len(set(whole)) >= 3
    assert len({(int(a), cut[i]) for a, (i, _) in zip(whole, rows)}) == len(set(whole)) == len(set(cut.values()))
    assert all((a < 0) == (cut[i] < 0) for a, (i, _) in zip(whole, rows))


def test_hdbscan_compares_no_copies(spark, monkeypatch):
    """40,000 rows at 25 places are 25 points."""
    seen = []
    monkeypatch.setattr(density, "_least_tree", lambda edges, real=density._least_tree: seen.append(edges.count()) or real(edges))
    df = spark.range(40_000).selectExpr("'all' as g", "id", "array(cast(id % 25 as double) * 10, 1.0D) as v")
    found = density.hdbscan(df, "g", "id", "v", method="eom")
    assert found.selectExpr("id % 25 as place", "cluster_id").distinct().filter("cluster_id >= 0").count() == 25 and seen == [24]


def test_inference(spark):
    best, score = inference.pick(np.array([[1.0, 1.0], [0.0, 3.0], [np.nan, 1.0]]))
    assert best.tolist() == [0, 1, 0] and score[2] == 0 and score[0] == pytest.approx(0.5)

    def failing(texts, labels):
        raise RuntimeError

    df = spark.createDataFrame([("1", "why?"), ("2", ""), ("3", None), ("4", "oh!")], "id string, body string")
    assert {r.row_id: r.nlp_label for r in inference.classify(df, "id", "body").collect()} == {"1": "idea", "4": "pain_point"}
    assert {(r.nlp_label, r.nlp_score) for r in inference.classify(df, "id", "body", failing).collect()} == {("none", 0.0)}
    assert [len(r.embedding) for r in inference.embed(df, "body", width=16).collect()] == [16] * 4

    def client(prompt):
        if "bad" in prompt:
            raise ValueError("x")
        return '```json\n{"viability_score": 7, "cluster_summary": "s"}\n```' if "ok" in prompt else "[]"

    asked = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "list"), (4, None)], "cluster_id int, p string")
    got = {r.cluster_id: (r.viability_score, r.error) for r in inference.ask(asked, "p", ["cluster_id"], client=client).collect()}
    assert got == {1: (7, None), 2: (None, "ValueError: x"), 3: (None, "not an object"), 4: (None, "not an object")}


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox", 0, 5), (2, "red red dog", 3, 4), (3, None, 0, 4), (4, "", None, 1)], "id int, t string, s int, total_ups int")
    index = search.build_index(docs, f"file://{tmp_path}/one", "id", ["t"], parts=4)
    page, total = search.search(docs, "id", index, {"t": 1.0}, "RED-fox", ranges={"s": (0, None)})
    assert [r.id for r in page.collect()] == [1, 2] and total.first().total == 2
    assert [r.id for r in search.search(docs, "id", sort="total_ups_desc", size=2, number=2)[0].collect()] == [3, 4]
    assert search.search(docs, "id", ranges={"s": (0, 0)})[1].first().total == 2
    assert search.relevance(index, " -- ", {"t": 1.0}).count() == 0 and search.search(docs, "id", number=99)[0].count() == 0
    assert search.search(docs, "id", index, {"t": 1.0}, " -- ")[1].first().total == 0
    two = docs.withColumn("u", F.lit("fox")).withColumn("n", F.struct(F.col("s").alias("deep"), F.array(F.lit("Fox den")).alias("list")))
    several = search.build_index(two, f"file://{tmp_path}/two", "id", ["t", "u", "n"], parts=4)
    scores = {r.id: r.score for r in search.relevance(several, "fox", {"t": 1.0, "u": 3.0}).collect()}
    assert set(scores) == {1, 2, 3, 4} and scores[1] == max(scores.values())
    assert {r.id for r in search.relevance(several, "den", {"n": 1.0}).collect()} == {1, 2, 3, 4} and search.relevance(several, "den", {"t": 1.0}).count() == 0
    none = search.build_index(docs.limit(0), f"file://{tmp_path}/none", "id", ["t"], parts=4)
    assert search.relevance(none, "x", {"t": 1.0}).count() == 0
    assert search.open_index(docs.limit(0), f"file://{tmp_path}/one", "id", ["t"], parts=4).postings.count() == 4  # it is there already
    long = spark.createDataFrame([(1, "word " * 100_000 + "end")], "id int, t string")
    assert search.relevance(search.build_index(long, f"file://{tmp_path}/long", "id", ["t"]), "end", {"t": 1.0}).count() == 1
    assert search.sort_key("popularity_desc", docs.columns) == ("total_ups", True)
    with pytest.raises(ValueError):
        search.sort_key("total_ups", docs.columns)
    rows, total = search.sample(docs, 2, 1, {"s": 0})
    assert {r.s for r in rows.collect()} == {0} and total.first().total == 2 and rows.collect() == search.sample(docs.repartition(3), 2, 1, {"s": 0})[0].collect()
    assert search.by_id(docs, "id", 2).first().t == "red red dog" and search.by_id(docs, "id", 9).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<float>")
    assert [r.id for r in search.similar_to(v, "id", "v", [1.0, 0.1], 5).collect()] == [1, 3]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("ab", "0124", 1), ("", "0124", 2), (None, "1223", 3)], "p string, mmyy string, v int")
    sinks.write_partitioned(df, path, ["p", "mmyy"])
    assert {(r.p, r.mmyy, r.v) for r in spark.read.parquet(path).collect()} == {("ab", "0124", 1), ("misc", "0124", 2), ("misc", "1223", 3)}
    sinks.consolidate(spark, path, df.limit(1), ["p", "mmyy"])
    assert spark.read.parquet(path).count() == 4
    changed = sinks.rewrite(spark, path, lambda t: t.withColumn("plan", F.lit("")), dry_run=True)
    assert "plan" in changed.columns and "plan" not in spark.read.parquet(path).columns
    assert "plan" in sinks.rewrite(spark, path, lambda t: t.withColumn("plan", F.lit(""))).columns
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, "k", F.col("v")).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in sinks.insert_new(old, new, ["k"]).collect()} == {(3, "z")}
    copy = sinks.snapshot(spark, path)
    assert spark.read.parquet(copy).count() == 4
    with pytest.raises(ValueError):
        sinks.drop_table(spark, copy)
    assert sinks.drop_table(spark, copy, confirm=True) and not sinks.exists(spark, copy)


def test_tables(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, "a")], "x int, s string").write.parquet(f"{base}/p/one")
    spark.createDataFrame([(2, 5)], "x int, y int").write.parquet(f"{base}/p/two")
    both = tables.scan(spark, [f"{base}/p/one", f"{base}/p/two"], by_name=True)
    assert set(both.columns) == {"x", "s", "y"} and both.count() == 2
    assert tables.with_file(tables.scan(spark, f"{base}/p", deep=True)).select("filename").distinct().count() == 2
    (tmp_path / "p/bad.parquet").write_bytes(b"")
    (tmp_path / "p/worse.parquet").write_bytes(b"PAR1 no end")
    found = {r.path.rpartition("/")[2]: r.reason for r in tables.damaged_files(spark, f"{base}/p").collect()}
    assert set(found) == {"bad.parquet", "worse.parquet"} and found["bad.parquet"] == "empty"
    assert [(p.rpartition("/")[2], d) for p, d in tables.repair(spark, f"{base}/p")] == [("bad.parquet", "deleted"), ("worse.parquet", "deleted")]
    assert (tmp_path / "p/bad.parquet").exists()
    assert tables.folder_catalog(spark, f"{base}/p") == ["one", "two"] and tables.folder_catalog(spark, f"{base}/p", "O*") == ["one"]
    both.select("x").write.option("header", "true").csv(f"{base}/csv")
    tables.merge_csv(spark, f"{base}/csv", f"{base}/merged")
    assert spark.read.option("header", "true").csv(f"{base}/merged").count() == 2
    assert tables.inspect(both)["rows"] == 2


def test_relations(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "p int, t int")
    assert relations.attach(a, spark.createDataFrame([(1, 2), (2, 2), (2, 2)], "p int, t int")).count() == 3
    assert relations.detach(a, a.limit(1)).count() == 1
    with pytest.raises(ValueError):
        relations.same_schema_union([a, a.withColumnRenamed("p", "q")])
    u = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "k string, v int")
    assert relations.unique_by(u, ["k"]).count() == 3
    assert relations.cascade(u, spark.createDataFrame([("x",)], "id string"), "k", "id").count() == 2


def test_streams(spark, tmp_path):
    from loomspark.streaming import queues

    base = f"file://{tmp_path}"
    spark.createDataFrame([("f", "1", "why?"), ("f", "1", "why?"), ("f", "2", "")], "file_path string, row_id string, text string").write.parquet(f"{base}/q")
    for _ in range(2):  # a second start finds nothing new
        queues.consume(spark, f"{base}/q", f"{base}/r", f"{base}/c").awaitTermination()
    assert spark.read.parquet(f"{base}/r").count() == 2
    spark.read.parquet(f"{base}/r").write.parquet(f"{base}/rq")
    apply = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/a/{n}")
    queues.write_back_stream(spark, f"{base}/rq", f"{base}/s", f"{base}/c2", apply).awaitTermination()
    spark.read.parquet(f"{base}/r").limit(1).write.mode("append").parquet(f"{base}/rq")
    queues.write_back_stream(spark, f"{base}/rq", f"{base}/s", f"{base}/c2", apply).awaitTermination()
    assert spark.read.parquet(f"{base}/a/*").count() == 1
    m = spark.createDataFrame([("1", False, None)], "id string, is_idea boolean, nlp_top_score float")
    assert queues.refresh(spark, m, f"{base}/a").first().is_idea is True


def test_validation_and_defaults(spark):
    from loomspark.operators import messages as M

    rows = [("1", "ab", " x ", 1), ("2", "a", "x", 1), ("", "ab", "x", 1), ("4", "ab", "  ", 1), ("5", None, "x", 1), ("6", "ab", "y", None)]
    df = spark.createDataFrame(rows, "id string, subreddit string, body string, ups int")
    assert [(r.id, r.body) for r in M.validated(df).collect()] == [("1", "x"), ("6", "y")]
    assert [(r.id, r.ups) for r in M.present(M.validated(df), ["ups"]).collect()] == [("1", "1")]
    j = spark.createDataFrame([('{"a": "x", "b": null}',), ("{bad",), (None,)], "j string")
    assert [(r.a, r.b) for r in M.json_fields(j, "j", {"a": "-", "b": None}).collect()] == [("x", None), ("-", None), ("-", None)]


def test_random_row_and_plans(spark):
    df = spark.createDataFrame([(i,) for i in range(9)], "i int")
    one = search.random_row(df, [F.asc("i")], 3).collect()
    assert one == search.random_row(df, [F.asc("i")], 3).collect() and len(one) == 1
    assert search.random_row(df.limit(0), [F.asc("i")], 3).count() == 0
    assert inference.repaired(inference.offline_planner)("t").startswith('{"title": "t"')


def test_packed_dumps(spark, tmp_path):
    import zstandard

    from loomspark.sources import dumps

    lines = [f'{{"id": "{i}", "body": "{"x" * 2000}"}}' for i in range(5_000)] + ['{"id": "last"}']
    whole = zstandard.ZstdCompressor().compress("\n".join(lines).encode() + b"\n\xff{bad utf-8")
    (tmp_path / "RC_1.zst").write_bytes(whole)
    (tmp_path / "RC_2.zst").write_bytes(zstandard.ZstdCompressor(write_checksum=True).compress(b'{"id": "a"}\r\n') + whole[: len(whole) // 2])
    (tmp_path / "RS_1.jsonl").write_text('{"id": "s"}\n\nnot json\n')
    files = dumps.discover(spark, f"file://{tmp_path}")
    assert sorted((r.name, r.kind) for r in files.collect()) == [("RC_1.zst", "comment"), ("RC_2.zst", "comment"), ("RS_1.jsonl", "submission")]
    read = lambda name: dumps.parse_items(dumps.read_lines(spark, f"file://{tmp_path}/{name}", parts=2))
    assert read("RC_1.zst").count() == 5_001 and read("RS_1.jsonl").count() == 1
    cut = read("RC_2.zst")
    assert 1 <= cut.count() < 5_001 and cut.filter("id = 'a'").count() == 1
    assert dumps.read_lines(spark, [f"file://{tmp_path}/RC_1.zst", f"file://{tmp_path}/RS_1.jsonl"]).count() == 5_002 + 3
    dumps.write_lines(spark.createDataFrame([("é",), ("b",)], "value string"), f"file://{tmp_path}/out", "RS_9", pack=True)
    assert sorted(r.line for r in dumps.read_lines(spark, f"file://{tmp_path}/out/*.zst").collect()) == ["b", "é"]


def test_repaired_answers(spark):
    from loomspark.functions import text as X

    for raw, want in (
        (r'{"a": "C:\users"}', r"C:\users"), (r'{"a": "x\\cy"}', r"x\cy"), (r'{"a": "x\\\cy"}', r"x\\cy".replace("\\\\", "\\" * 2)), (r'{"a": "\u00e9\"q\""}', 'é"q"'),
        ('```json\n{"a": "t"}\n```', "t"), (r'{"a": "\d\u12"}', r"\d\u12"),
    ):
        df = spark.createDataFrame([(raw,)], "r string").select(F.from_json(X.repair_json(F.col("r")), "a string").alias("p"))
        assert df.first().p.a == want, raw
        import json

        assert json.loads(inference.repaired(lambda _: raw)(""))["a"] == want


def test_calls_run_at_once_and_in_windows(spark):
    import time

    def slow(prompt):
        time.sleep(0.2)
        return '{"score": 3, "reasoning": "r"}'

    df = spark.createDataFrame([(i, "p") for i in range(40)], "i int, p string").coalesce(1)
    began = time.monotonic()
    assert inference.rate(df, "p", ["i"], slow, at_once=40).filter("score = 3").count() == 40
    assert time.monotonic() - began < 0.2 * 40 / 2
    began = time.monotonic()
    assert inference.rate(df.limit(4), "p", ["i"], slow, per_window=2, window=1.5).count() == 4 and time.monotonic() - began > 1.5

    def broken(prompt):
        raise ValueError("no")

    assert {(r.score, r.reasoning) for r in inference.rate(df.limit(2), "p", ["i"], broken).collect()} == {(0.0, "failed: ValueError: no")}
    assert {r.answer for r in inference.told(df.limit(2), "p", ["i"], broken).collect()} == {None}


def test_brake_and_resume(spark, tmp_path):
    from loomspark.streaming import queues

    m = spark.createDataFrame([(str(i), "an idea", True, False, None) for i in range(25)], "id string, body string, cpu_filter_is_idea boolean, is_idea boolean, nlp_top_score float")
    waits = iter([9, 9, 0, 0, 0])
    assert queues.enqueue_slowly(m, f"file://{tmp_path}/q", lambda: next(waits), rows_per_push=10, most=5, wait=0.01) == 3
    assert spark.read.parquet(f"file://{tmp_path}/q").count() == 25 and queues.backlog(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/none") == 25
    lines = spark.createDataFrame([("f", i, str(i)) for i in range(5)] + [("g", 0, None)], "file_path string, line_number long, id string")
    stored = spark.createDataFrame([("0",), ("2",), ("2",), (None,)], "id string")
    assert {tuple(r) for r in writeback.resume_points(lines, stored).collect()} == {("f", 5, 3), ("g", 1, 0)}


def test_mappings_and_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t", 5)], "id long, title string, extra int")
    out, mapping = sinks.extended(docs, "id bigint, title string, gone string")
    assert out.columns == ["id", "title", "gone", "extra"] and mapping.endswith("extra string") and out.first().extra == "5"
    path = f"file://{tmp_path}/v"
    points = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, payload string")
    sinks.upsert_vectors(spark, path, points([("a", [3.0, 4.0], "old"), ("b", [1.0, 0.0], "b"), ("z", [0.0, 0.0], "z"), ("n", None, "n")]), buckets=2)
    sinks.upsert_vectors(spark, path, points([("a", [0.0, 2.0], "new"), ("c", [1.0, 1.0], "c")]), buckets=2)
    got = {r.id: (r.payload, round(sum(x * x for x in r.vector), 4)) for r in spark.read.parquet(path).collect()}
    assert got == {"a": ("new", 1.0), "b": ("b", 1.0), "c": ("c", 1.0)}


def test_lists_of_children(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "b"), (1, "a"), (None, "x")], "p int, name string")
    got = {r.id: [c.name for c in r.kids] for r in relations.with_children(parents, children, "id", "p", ["name"], "kids").collect()}
    assert got == {1: ["a", "b"], 2: []}
    assert [len(r.kids) for r in relations.with_children(parents, children, "id", "p", ["name"], "kids", most=1).orderBy("id").collect()] == [1, 0]
    assert relations.memberships(children, children).count() == 3
