"""Parent-child rows of unknown depth to tops, depths, paths, descendants and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip_type
from loomspark.operators import skew
from loomspark.runtime import discard, materialize

LOCAL = "id string, parent string, top string, hops long, state string, link string"
ROOT, OPEN = -1, -2


def resolve(
    df: DataFrame,
    id_col: str,
    parent: Column,
    hint: Column | None = None,
    fragment_rows: int = 500_000,
    colocate_rows: int = 1_000_000,
    heavy_rows: int = 100_000,
) -> DataFrame:
    """Per distinct id: parent, state ('complete', 'broken', 'cycle'), top and hops.

    `parent` is null or '' for a top. A path that ends at an id that isn't in the table is
    'broken', one that never ends 'cycle', with the least id of the cycle as top and -1 hops. Rows
    with null or '' id are left out; of repeated ids with different parents the least parent
    holds (a null only if all are null). Other columns are ignored.

    Components are found by contraction. `hint` is any guess at what belongs together, right or
    wrong (e.g. a thread id). Rows are range-partitioned by (hint, id), so a giant component is cut
    into bounded fragments of at most `fragment_rows`; within each a depth-first walk with node
    colours finds tops, depths and back edges. What is left is one row per parent that lies in another
    fragment or nowhere: those rows are walked in the same way if there are at most `colocate_rows`
    of them, else by pointer doubling. Parents with over `heavy_rows` rows below them are joined back by broadcast.
    """
    clean = F.nullif(parent, F.lit(""))
    guess = F.coalesce(*([F.nullif(hint, F.lit(""))] if hint is not None else []), clean, F.col(id_col))
    nodes = (
        df.select(F.col(id_col).alias("id"), clean.alias("parent"), guess.alias("hint"))
        .filter("id is not null and id <> ''")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"), F.min("hint").alias("hint"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(parts, "hint", "id").sortWithinPartitions("hint")
    local = materialize(placed.select("id", "parent").mapInArrow(_walk_fragments(fragment_rows), LOCAL), "fragments")

    # parents that lie in another fragment or nowhere; one row each, however many children they have
    opened = local.filter("state = 'open'")
    missing = opened.groupBy("link").agg(F.count(F.lit(1)).alias("load"))
    landing = local.select(
        F.col("id").alias("link"), F.col("top").alias("own"), (F.col("hops") + 1).alias("step"),
        F.col("state").alias("found"), F.col("link").alias("next"),
    )
    links = materialize(
        missing.join(landing, "link", "left").select("link", "load", "own", "step", "next", F.coalesce("found", F.lit("missing")).alias("state")), "links"
    )
    n_links = links.count()
    done = local.select("id", "parent", "top", "hops", "state")
    if n_links:
        schema = "link string, load long, final string, extra long, end string"
        settled = links.coalesce(1).mapInArrow(_walk_links, schema) if n_links <= colocate_rows else _double(links)
        settled = materialize(settled, "settled")
        by_link = skew.lookup(opened, settled, "link", heavy_rows=heavy_rows)
        joined = by_link.select(
            "id", "parent",
            F.when(F.col("end") == "missing", F.col("top")).otherwise(F.col("final")).alias("top"),
            F.when(F.col("end") == "missing", F.col("hops")).otherwise(F.col("hops") + F.col("extra")).alias("hops"),
            F.when(F.col("end") == "missing", "broken").otherwise(F.col("end")).alias("state"),
        )
        done = done.filter("state <> 'open'").unionByName(joined)
        if not settled.filter("end = 'loop'").isEmpty():
            done = materialize(done, "resolved")
            fixed = _close_loops(done.filter("state = 'loop'"), colocate_rows)
            done = done.filter("state <> 'loop'").unionByName(fixed)
    return done.select(
        "id", "parent", "state", "top", F.when(F.col("state") == "cycle", -1).otherwise(F.col("hops")).cast("int").alias("hops")
    )


def walk(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth-first walks along parent positions, with node colours.

    `parent` holds positions, or a negative number where a walk ends. Returns per node the position
    where its walk ends, the steps to it, and whether it runs into a cycle; then the end is the
    cycle's node that was reached first and the steps are 0.
    """
    n = len(parent)
    up = parent.tolist()
    colour = bytearray(n)  # 0 new, 1 on the walk, 2 done
    end, steps, loop = [0] * n, [0] * n, bytearray(n)
    for start in range(n):
        if colour[start]:
            continue
        trail, v = [], start
        while v >= 0 and not colour[v]:
            colour[v] = 1
            trail.append(v)
            v = up[v]
        if v < 0:
            top, depth, cyc = trail[-1], -1, 0
        elif colour[v] == 1:  # back edge
            top, depth, cyc = v, -1, 1
        else:
            top, depth, cyc = end[v], steps[v], loop[v]
        for u in reversed(trail):
            depth += 1
            end[u], steps[u], loop[u], colour[u] = top, 0 if cyc else depth, cyc, 2
    return np.array(end, dtype=np.int64), np.array(steps, dtype=np.int64), np.frombuffer(bytes(loop), dtype=np.uint8)


def _least_on_cycles(ids: np.ndarray, parent: np.ndarray, end: np.ndarray, loop: np.ndarray) -> dict[int, str]:
    """For each cycle, by the position where walks entered it: the least id on it."""
    least = {}
    for entry in np.unique(end[loop == 1]).tolist():
        low, v = ids[entry], int(parent[entry])
        while v != entry:
            low = min(low, ids[v])
            v = int(parent[v])
        least[entry] = low
    return least


def _walk_fragments(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield from _fragment(held)
                held, rows = [], 0
        if rows:
            yield from _fragment(held)

    return run


def _fragment(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frame = pa.Table.from_batches(held)
    ids = frame.column("id").to_numpy(zero_copy_only=False)
    parents = frame.column("parent").to_numpy(zero_copy_only=False)
    top_itself = frame.column("parent").is_null().to_numpy()
    at = pd.Index(ids).get_indexer(parents)
    pos = np.where(top_itself, ROOT, np.where(at >= 0, at, OPEN))
    end, steps, loop = walk(pos)
    low = _least_on_cycles(ids, pos, end, loop)
    ends_open = (pos[end] == OPEN) & (loop == 0)
    top = ids[end]
    for i in np.flatnonzero(loop).tolist():
        top[i] = low[int(end[i])]
    state = np.where(loop == 1, "cycle", np.where(ends_open, "open", "complete"))
    link = np.where(ends_open, parents[end], None)
    yield from pa.table(
        {
            "id": pa.array(ids, pa.string()), "parent": pa.array(parents, pa.string()), "top": pa.array(top, pa.string()),
            "hops": steps, "state": pa.array(state.tolist(), pa.string()), "link": pa.array(link, pa.string()),
        }
    ).to_batches(max_chunksize=50_000)


def _walk_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Missing parents as nodes of a smaller graph; a step stands for the hops within a fragment."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    frame = pa.Table.from_batches(held).to_pandas()
    link, own, state = frame["link"].to_numpy(), frame["own"].tolist(), frame["state"].tolist()
    up = pd.Index(link).get_indexer(frame["next"].to_numpy())
    up = np.where((frame["state"] == "open").to_numpy(), up, -1).tolist()
    step = frame["step"].fillna(0).astype("int64").tolist()
    n = len(link)
    final, extra, end, colour = [None] * n, [0] * n, [""] * n, bytearray(n)
    for start in range(n):
        trail, v = [], start
        while v >= 0 and not colour[v]:
            colour[v] = 1
            trail.append(v)
            v = up[v]
        if v < 0:
            v = trail.pop()
            final[v], extra[v], end[v], colour[v] = own[v], step[v], state[v], 2
        looped = colour[v] == 1
        for u in reversed(trail):
            colour[u] = 2
            if looped:
                end[u] = "loop"
            elif end[up[u]] == "missing":  # u is the last that exists
                final[u], extra[u], end[u] = own[u], step[u], "broken"
            else:
                final[u], extra[u], end[u] = final[up[u]], step[u] + extra[up[u]], end[up[u]]
    yield from pa.table(
        {"link": pa.array(link, pa.string()), "load": pa.array(frame["load"], pa.int64()), "final": pa.array(final, pa.string()),
         "extra": pa.array(extra, pa.int64()), "end": pa.array(end, pa.string())}
    ).to_batches(max_chunksize=50_000)


def _double(links: DataFrame) -> DataFrame:
    """Pointer doubling: each round halves what is left of every path; loops never settle.

    `final` and `extra` stand for the stretch walked so far, and hold when it ends at a missing parent.
    """
    now = links.select("link", "load", "next", F.col("own").alias("final"), F.col("step").alias("extra"), F.col("state").alias("end"))
    left = -1
    while True:
        now = materialize(now, "doubling")
        pending = now.filter("end = 'open'").count()
        if pending in (0, left):
            break
        left = pending
        still = now.filter("end = 'open'")
        asked = still.groupBy("next").agg(F.count(F.lit(1)).alias("asked"))
        ahead = now.select(
            F.col("link").alias("next"), F.col("next").alias("n2"), F.col("final").alias("f2"), F.col("extra").alias("e2"), F.col("end").alias("s2")
        ).join(asked, "next")
        gone = F.col("s2") == "missing"
        moved = skew.lookup(still, ahead, "next", load="asked").select(
            "link", "load", F.col("n2").alias("next"),
            F.when(gone, F.col("final")).otherwise(F.col("f2")).alias("final"),
            F.when(gone, F.col("extra")).otherwise(F.col("extra") + F.col("e2")).alias("extra"),
            F.when(gone, "broken").otherwise(F.col("s2")).alias("end"),
        )
        now = now.filter("end <> 'open'").unionByName(moved)
    return now.select("link", "load", "final", "extra", F.when(F.col("end") == "open", "loop").otherwise(F.col("end")).alias("end"))


def _close_loops(nodes: DataFrame, colocate_rows: int) -> DataFrame:
    """Cycles that cross fragments: every node here leads into one."""
    n = nodes.count()
    if n <= colocate_rows:
        return nodes.select("id", "parent").coalesce(1).mapInArrow(_walk_all_cycles, "id string, parent string, top string, hops long, state string")
    jump = nodes.select("id", "parent", F.col("parent").alias("ahead"), F.least("id", "parent").alias("low"))
    # the window of `low` covers the next 2^k nodes; past n nodes all of a cycle is covered
    for _ in range(int(n).bit_length() + 1):
        jump = materialize(jump, "loops")
        other = jump.select(F.col("id").alias("ahead"), F.col("ahead").alias("a2"), F.col("low").alias("l2"))
        jump = jump.join(other, "ahead").select(
            "id", "parent", F.col("a2").alias("ahead"), F.least("low", "l2").alias("low")
        )
    jump = materialize(jump, "loops")
    # `ahead` lies on the cycle by now, and what follows it is the cycle alone
    entry = jump.select(F.col("id").alias("ahead"), F.col("low").alias("top"))
    return jump.join(entry, "ahead").select(
        "id", "parent", "top", F.lit(0).cast("long").alias("hops"), F.lit("cycle").alias("state")
    )


def _walk_all_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    for batch in _fragment(held):
        yield batch.drop_columns(["link"])


def paths(resolved: DataFrame, fragment_rows: int = 500_000) -> DataFrame:
    """The resolved rows plus `path`: ids from the top to the node itself.

    For a 'broken' node the path starts at its last known ancestor; for a 'cycle' node `path` is null, as
    it has no end. Trees of up to `fragment_rows` nodes are co-located and walked; larger ones get
    their paths by doubling ancestor lists, which needs no tree to fit into one task.
    """
    resolved = materialize(resolved, "resolved")
    parts = int(resolved.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    giant = resolved.groupBy("top").count().filter(F.col("count") > fragment_rows).select("top")
    ends = resolved.filter("state <> 'cycle'")
    schema = "id string, parent string, state string, top string, hops int, path array<string>"
    small = (
        ends.join(giant, "top", "left_anti").select("id", "parent", "state", "top", "hops")
        .repartition(parts, "top").sortWithinPartitions("top").mapInArrow(_emit_paths(fragment_rows), schema)
    )
    cyc = resolved.filter("state = 'cycle'").withColumn("path", F.lit(None).cast("array<string>"))
    out = small.unionByName(cyc.select(*small.columns))
    big = ends.join(giant, "top", "left_semi")
    if not big.isEmpty():
        out = out.unionByName(_double_paths(big).select(*small.columns))
    return out


def _emit_paths(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch.to_pandas())
            rows += batch.num_rows
            if rows > limit:  # whole trees only: keep the last, perhaps unfinished one
                frame = pd.concat(held, ignore_index=True)
                unfinished = frame["top"] == frame["top"].iloc[-1]
                if not unfinished.all():
                    yield from _paths_of(frame[~unfinished])
                held, rows = [frame[unfinished]], int(unfinished.sum())
        if rows:
            yield from _paths_of(pd.concat(held, ignore_index=True))

    return run


def _paths_of(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    frame = frame.reset_index(drop=True)
    ids = frame["id"].to_numpy()
    up = pd.Index(ids).get_indexer(frame["parent"].to_numpy())
    for lo in range(0, len(frame), 5_000):
        part = frame.iloc[lo : lo + 5_000]
        found = []
        for v in range(lo, lo + len(part)):
            trail = []
            while v >= 0:
                trail.append(ids[v])
                v = up[v]
            found.append(trail[::-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[c], t) for c, t in (("id", pa.string()), ("parent", pa.string()), ("state", pa.string()), ("top", pa.string()), ("hops", pa.int32()))]
            + [pa.array(found, pa.list_(pa.string()))],
            ["id", "parent", "state", "top", "hops", "path"],
        )


def _double_paths(big: DataFrame) -> DataFrame:
    """Each round joins a node's known stretch of ancestors to the stretch before it."""
    deepest = big.agg(F.max("hops")).first()[0] or 0
    now = big.withColumn("path", F.array("id")).withColumn("before", F.when(F.col("hops") > 0, F.col("parent")))
    for _ in range(int(deepest).bit_length()):
        now = materialize(now, "paths")
        other = now.select(F.col("id").alias("before"), F.col("path").alias("p2"), F.col("before").alias("b2"))
        todo = now.filter("before is not null")
        asked = todo.groupBy("before").agg(F.count(F.lit(1)).alias("asked"))
        open_ = skew.lookup(todo, other.join(asked, "before"), "before", load="asked").select(
            *[c for c in big.columns], F.concat("p2", "path").alias("path"), F.col("b2").alias("before")
        )
        now = now.filter("before is null").unionByName(open_.select(*now.columns))
    return now


def descendants(with_paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of the forest, distance 1 or more."""
    size = F.size("path")
    return (
        with_paths.filter("path is not null")
        .select("id", size.alias("n"), F.posexplode(F.slice("path", F.lit(1), size - 1)).alias("i", "ancestor"))
        .select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("i")).alias("distance"))
    )


def cycles(resolved: DataFrame, heavy_rows: int = 100_000) -> DataFrame:
    """(id, parent, cycle, back): the nodes that lie on a cycle themselves, not those that hang off one.

    `cycle` is the least id of the cycle; `back` marks the back edge, from this node to that one. Jumps of doubling length are
    taken until the nodes they end at stay the same: those are the nodes on cycles, however long or deep they are.
    """
    nodes = materialize(resolved.filter("state = 'cycle'").select("id", "parent", F.col("top").alias("cycle")), "on-cycles")
    jumps, n = nodes.select("id", F.col("parent").alias("jump")), None
    while True:
        ends = jumps.groupBy("jump").agg(F.count(F.lit(1)).alias("load"))
        m = ends.count()
        if m == n or not m:
            break
        n = m
        further = jumps.select(F.col("id").alias("jump"), F.col("jump").alias("next")).join(ends, "jump")
        longer = materialize(skew.lookup(jumps, further, "jump", heavy_rows=heavy_rows).select("id", F.col("next").alias("jump")), "jumps")
        discard(jumps)
        jumps = longer
    on = jumps.select(F.col("jump").alias("id")).distinct()
    return nodes.join(on, "id", "left_semi").select("id", "parent", "cycle", (F.col("parent") == F.col("cycle")).alias("back"))


def message_forest(messages: DataFrame) -> DataFrame:
    """`resolve` for messages; thread ids, which may be wrong, only guide the placement."""
    hint = F.coalesce(F.nullif(strip_type(F.col("link_id")), F.lit("")), F.nullif(F.col("trunc_link_id"), F.lit("")))
    return resolve(messages, "id", strip_type(F.col("parent_id")), hint)
