import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import hierarchy

SCHEMA = "id string, parent string, hint string, top string, state string"


def brute(rows):
    up = {}
    for i, p, *_ in rows:
        if i:
            up.setdefault(i, []).append(p or None)
    up = {i: min((p for p in ps if p), default=None) for i, ps in up.items()}
    out = {}
    for i in up:
        trail = [i]
        while True:
            p = up[trail[-1]]
            if p is None:
                out[i] = ("complete", trail[-1], len(trail) - 1)
            elif p not in up:
                out[i] = ("broken", trail[-1], len(trail) - 1)
            elif p in trail:
                out[i] = ("cycle", min(trail[trail.index(p):]), -1)
            else:
                trail.append(p)
                continue
            break
    return out


def resolve(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return hierarchy.resolve(df, "id", F.col("parent"), F.col("hint"), **kw)


def states(df):
    return {r.id: (r.state, r.top, r.hops) for r in df.collect()}


CASES = [("a", None, "1"), ("b", "a", "1"), ("c", "b", "2"), ("d", "x", None), ("e", "d", "3"), ("f", "g", "4"), ("g", "f", "5"), ("h", "g", "6"), ("i", "", "1"), ("s", "s", "1"), ("t", "s", "9"), ("b", "a", "7"), (None, "a", "1"), ("", "a", "1")]


@pytest.mark.parametrize("kw", [{}, {"fragment_rows": 2}, {"fragment_rows": 2, "colocate_rows": 0}, {"fragment_rows": 3, "heavy_rows": 0}])
def test_states(spark, kw):
    assert states(resolve(spark, CASES, **kw)) == brute(CASES)


@pytest.mark.parametrize("kw", [{"fragment_rows": 7}, {"fragment_rows": 7, "colocate_rows": 0}, {"fragment_rows": 5, "colocate_rows": 0, "heavy_rows": 3}])
def test_random_forest_with_cycles(spark, kw):
    rnd = random.Random(3)
    rows = [(f"n{i}", rnd.choice([None, f"n{rnd.randrange(300)}", f"n{max(0, i - 1)}", "gone"]), rnd.choice(["x", "y", None, f"h{i % 40}"])) for i in range(240)]
    rows += [(f"c{i}", f"c{(i + 1) % 17}", f"h{i}") for i in range(17)] + [("hang", "c3", "z")]
    assert states(resolve(spark, rows, **kw)) == brute(rows)


def test_one_parent_of_a_third(spark):
    rows = [("root", None, "r")] + [(f"k{i}", "root", f"h{i % 50}") for i in range(400)] + [(f"m{i}", "absent", f"h{i % 50}") for i in range(400)]
    rows += [(f"g{i}", f"k{i}", None) for i in range(400)]
    for kw in ({"fragment_rows": 40}, {"fragment_rows": 40, "colocate_rows": 0, "heavy_rows": 20}):
        assert states(resolve(spark, rows, **kw)) == brute(rows)


def test_deep_chain_and_paths(spark):
    rows = [(f"d{i:04d}", f"d{i - 1:04d}" if i else None, f"h{i % 13}") for i in range(700)]
    found = resolve(spark, rows, fragment_rows=50)
    assert states(found) == brute(rows)
    for limit in (10_000, 100):  # walked in one task, or doubled
        ways = {r.id: r.path for r in hierarchy.paths(found, fragment_rows=limit).collect()}
        assert ways["d0699"] == [r[0] for r in rows] and ways["d0000"] == ["d0000"]


def test_paths_and_descendants(spark):
    p = hierarchy.paths(resolve(spark, CASES))
    ways = {r.id: r.path for r in p.collect()}
    assert ways["c"] == ["a", "b", "c"] and ways["e"] == ["d", "e"] and ways["f"] is None and len(ways) == len(brute(CASES))
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(p).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("d", "e", 1)}


def test_empty(spark):
    found = resolve(spark, [])
    assert states(found) == {}
    assert hierarchy.paths(found).count() == 0


@settings(max_examples=40, suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.lists(st.integers(-1, 9), min_size=1, max_size=10))
def test_walk(parents):
    import numpy as np

    parents = [p if p < len(parents) else -1 for p in parents]
    end, steps, loop = hierarchy.walk(np.array(parents))
    want = brute([(str(i), None if p < 0 else str(p)) for i, p in enumerate(parents)])
    for i in range(len(parents)):
        state, top, hops = want[str(i)]
        assert (state == "cycle") == bool(loop[i])
        if state == "complete":
            assert (str(end[i]), steps[i]) == (top, hops)


def test_nodes_on_cycles_and_back_edges(spark):
    """A loop of its own, a loop of three with a long tail, a hub that hangs off a loop, and trees."""
    rows = [("s", "s"), ("c", "a"), ("a", "b"), ("b", "c"), ("t0", "b"), ("r", None), ("r2", "r")]
    rows += [(f"t{i + 1}", f"t{i}") for i in range(40)] + [(f"h{i}", "t40") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, parent string")
    found = hierarchy.resolve(df, "id", F.col("parent"))
    for heavy in (100_000, 5):
        got = {(r.id, r.parent, r.cycle, r.back) for r in hierarchy.cycles(found, heavy).collect()}
        assert got == {("s", "s", "s", True), ("a", "b", "a", False), ("b", "c", "a", False), ("c", "a", "a", True)}
    assert hierarchy.cycles(found.filter("id like 'r%'")).count() == 0
