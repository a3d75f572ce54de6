import numpy as np
import pytest

from loomspark.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, v string, id string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y", "z") for i, v in rows], SCHEMA)


def brute(rows, k):
    ok = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) == W and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)}
    out = {}
    for i, a in ok.items():
        sims = sorted((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), j) for j, b in ok.items() if j != i)
        out[i] = sims[:k]
    return out


W = 8


def test_dirty_vectors_and_exactness_on_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(rng.normal(size=W))) for i in range(60)]
    rows += [(100, None), (101, [0.0] * W), (102, [1.0] * 3), (103, [float("nan")] * W), (104, [1.0] * (W - 1) + [None]), (105, [float("inf")] * W), (106, [])]
    got = {}
    for r in nb.nearest(frame(spark, rows), width=W, k=5).collect():
        got.setdefault(r.id, []).append((r.place, r.neighbour, r.similarity))
    want = brute(rows, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [p for p, *_ in sorted(got[i])] == [1, 2, 3, 4, 5]
        assert [s for *_, s in sorted(got[i])] == pytest.approx([-s for s, _ in near], abs=2e-3)


def test_copies_have_each_other_first(spark):
    rng = np.random.default_rng(2)
    base = list(rng.normal(size=W))
    rows = [(i, [x * (1 + i % 3) for x in base]) for i in range(200)] + [(1000 + i, list(rng.normal(size=W))) for i in range(30)]
    got = {}
    for r in nb.nearest(frame(spark, rows), width=W, k=4).collect():
        got.setdefault(r.id, []).append((r.place, r.neighbour, r.similarity))
    assert len(got) == 230 and all(len(v) == 4 for v in got.values())
    for i in range(200):
        assert all(n < 200 and s > 0.999 for _, n, s in got[i]) and i not in {n for _, n, _ in got[i]}


def test_empty_and_too_few(spark):
    assert nb.nearest(frame(spark, []), width=W).count() == 0
    assert nb.nearest(frame(spark, [(1, [1.0] * W)]), width=W).count() == 0
    assert nb.nearest(frame(spark, [(1, [1.0] * W), (2, [2.0] * W), (3, [-1.0] * W)]), width=W).count() == 6


def test_recall_with_many_leaves_and_split_leaves(spark, monkeypatch):
    monkeypatch.setattr(nb, "TASK_ROWS", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, W))
    rows = [(i, list(centres[i % 40] + 0.25 * rng.normal(size=W))) for i in range(2000)]
    df = frame(spark, rows).cache()
    near = nb.nearest(df, width=W, k=10, leaf_rows=200)
    got = {}
    for r in near.filter("id % 100 = 0").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = {}
    for r in nb.exact(df, df.filter("vec_id % 100 = 0"), width=W, k=10, block=7).collect():
        want.setdefault(r.id, set()).add(r.neighbour)
    assert len(want) == 20
    assert sum(len(got[i] & want[i]) for i in want) / 200 >= 0.9


def recall(df, **kw):
    got, want = {}, {}
    for r in nb.nearest(df, width=W, k=10, **kw).filter("id % 100 = 0").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    for r in nb.exact(df, df.filter("vec_id % 100 = 0"), width=W, k=10).collect():
        want.setdefault(r.id, set()).add(r.neighbour)
    return sum(len(got[i] & want[i]) for i in want) / sum(map(len, want.values()))


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, W))
    return [(i, list(centres[i % 60] + 0.25 * rng.normal(size=W))) for i in range(n)]


def test_leaves_do_not_grow_with_the_table(spark):
    """Ten times the rows on the same small sample: more leaves, not larger ones, and the recall holds."""
    size = {}
    for n in (800, 8_000):
        df = frame(spark, clustered(n)).cache()
        slim = df.selectExpr("vec_id as id", "embedding as v")
        _, rows = nb._in_leaves(slim, n, 10, W, nb.TARGET, 150, 60)
        held = [r["count"] for r in rows.filter("place = 0").groupBy("leaf").count().collect()]
        assert sum(held) == n
        size[n] = max(held)
    assert size[8_000] <= 2 * 60 and len(held) >= 70
    assert recall(df, sample_rows=150, leaf_rows=60) >= 0.9


def test_the_sample_is_of_the_whole_table(spark):
    """A table in order of its regions: the last ones are in the sample like all others."""
    rows = sorted(clustered(6_000), key=lambda r: r[0] % 60)
    df = frame(spark, [(i, v) for i, (_, v) in enumerate(rows)])
    sample = nb._draw(df.selectExpr("vec_id as id", "embedding as v"), 6_000, 600, W)
    unit = np.array([v for _, v in rows], dtype=np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    place = np.argmax(sample @ unit.T, axis=1)
    assert len(sample) == 600 and 70 <= (place >= 5_000).sum() <= 130


def test_best_bin_first_visits_by_similarity():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(2000, W)).astype(np.float32)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tree = nb.Tree(sample, 60)
    order = tree.visit(sample[:50], tree.leaves)
    assert tree.leaves > 20 and all(sorted(row) == list(range(tree.leaves)) for row in order.tolist())
    assert nb.calibrate(tree, sample, 10, 0.99) >= nb.calibrate(tree, sample, 10, 0.5)


def test_only_similar_ones_need_few_visits(spark):
    """Pairs in one wide cloud: their leaves are few, though ten neighbours lie in most leaves; none is lost, in turns or not."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2_000, W))
    rows = [(2 * i + j, list(v + 0.15 * j * rng.normal(size=W))) for i, v in enumerate(base) for j in (0, 1)]
    df = frame(spark, rows).cache()
    slim = df.selectExpr("vec_id as id", "embedding as v")
    visits = {least: nb._in_leaves(slim, 4_000, 10, W, 0.99, 600, 60, least)[1].groupBy().max("place").first()[0] + 1 for least in (-2.0, 0.99)}
    assert 2 * visits[0.99] <= visits[-2.0]
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None]
    want = {(a, b) for a, b in np.argwhere(unit @ unit.T >= 0.99) if a < b}
    got = {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in nb.nearest(df, width=W, k=10, target=0.99, leaf_rows=60, sample_rows=600, least=0.99).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def test_turns_give_the_same(spark, monkeypatch):
    df = frame(spark, clustered(3_000)).cache()
    run = lambda: {tuple(r) for r in nb.nearest(df, width=W, k=5, leaf_rows=60, sample_rows=400).select("id", "neighbour", "place").collect()}
    monkeypatch.setattr(nb, "COPIES", 1_000)
    once = run()
    monkeypatch.setattr(nb, "COPIES", 2)
    assert run() == once
