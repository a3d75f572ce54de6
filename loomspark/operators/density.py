"""Density clustering of vectors: DBSCAN over all rows, HDBSCAN within groups, PCA before either."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.operators import skew
from loomspark.runtime import discard, materialize


def reduce(vectors: DataFrame, column: str, width: int = 15, least_rows: int = 17) -> DataFrame:
    """Principal components of an array column; unchanged if there are fewer than `least_rows` rows.

    A linear stand-in for manifold reducers, not equal to them.
    """
    if vectors.limit(least_rows).count() < least_rows:
        return vectors
    # one input split at a time goes through the covariance; the model is width x dimensions
    model = PCA(k=width, inputCol="_v", outputCol="_p").fit(vectors.select(array_to_vector(F.col(column)).alias("_v")))
    out = model.transform(vectors.withColumn("_v", array_to_vector(F.col(column))))
    return out.withColumn(column, vector_to_array("_p", "float32")).drop("_v", "_p")


PROBED = 512  # rows that the placement is planned on


def _anchors(vectors: DataFrame, column: str, count: int, eps: float) -> np.ndarray:
    """Anchors, as many as make the least comparisons on a bounded sample; one if distances are too small to tell rows apart."""
    rows = vectors.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(max(PROBED, count)).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x):
        return x
    best = (1.0, 1)
    k = min(count, len(x))
    while k > 1:
        near, home = _near(x, x[:k], eps)
        share = np.bincount(home, minlength=k) / len(x)
        held = (near.sum(axis=0) / len(x)) @ share  # a row of a cell is compared with all rows copied there
        cost = held + 0.02 * near.sum(axis=1).mean()  # and copies have to be shuffled
        best = min(best, (cost, k))
        k //= 2
    return x[: best[1]]


def _near(x: np.ndarray, anchors: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells a row could have a partner in, and its own cell."""
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (anchors**2).sum(1)[None, :] - 2 * x @ anchors.T))
    return d <= d.min(axis=1)[:, None] + 2 * eps + 1e-9, d.argmin(axis=1)


def _in_cells(vectors: DataFrame, id_col: str, column: str, eps: float, anchors: int, block_rows: int, extra: dict[str, str] | None = None) -> DataFrame | None:
    """Rows in the cells where they have to be compared: (cell, q, b, home, id, v) and extra columns; None without vectors.

    Rows go to the cell of their nearest anchor, and besides to every cell they could have a partner in: by the
    triangle inequality a partner within eps lies in a cell whose anchor is at most 2 * eps farther than the nearest one.
    A cell with many rows is compared in blocks of bounded size, every block of its own rows with every block of all its rows.
    """
    fixed = _anchors(vectors, column, anchors, eps)  # a bounded sample; only the placement depends on it
    if not len(fixed):
        return None
    extra = extra or {}
    id_type = dict(vectors.dtypes)[id_col]
    more = "".join(f", {c} {t}" for c, t in extra.items())

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            near, home = _near(x, fixed, eps)
            row, cell = np.nonzero(near)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(home[row] == cell), pa.array(cell, pa.int32()), batch.column(1).take(at), *[batch.column(2 + i).take(at) for i in range(len(extra))]],
                ["id", "home", "cell", "v", *extra],
            )

    usable = vectors.filter(F.col(column).isNotNull()).select(id_col, F.col(column).cast("array<float>"), *extra)
    placed = materialize(usable.mapInArrow(place, f"id {id_type}, home boolean, cell int, v array<float>{more}"), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row per anchor
    cut = placed.join(F.broadcast(sizes.select("cell", F.ceil(F.col("n") / block_rows).alias("blocks"))), "cell")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asked = cut.filter("home").select("cell", own.alias("q"), every.alias("b"), F.lit(True).alias("home"), "id", "v", *extra)
    held = cut.select("cell", every.alias("q"), own.alias("b"), F.lit(False).alias("home"), "id", "v", *extra)
    return asked.unionByName(held)


def _partners(table: pa.Table, eps: float):
    """Ids as a NumPy array, and chunks of (row, partner) positions within eps, without a row itself."""
    x = np.array(table.column("v").to_pylist(), dtype=np.float64)
    ids = table.column("id").to_numpy()
    is_home = table.column("home").to_numpy()
    home, rest = np.flatnonzero(is_home), np.flatnonzero(~is_home)
    sq = (x**2).sum(1)

    def chunks():
        for lo in range(0, len(home), 1024):
            rows = home[lo : lo + 1024]
            d2 = sq[rows][:, None] + sq[rest][None, :] - 2 * x[rows] @ x[rest].T
            i, j = np.nonzero(d2 <= eps * eps + 1e-12)
            a, b = rows[i], rest[j]
            differ = ids[a] != ids[b]
            yield a[differ], b[differ]

    return ids, chunks()


def close_pairs(vectors: DataFrame, id_col: str, column: str, eps: float, anchors: int = 64, block_rows: int = 20_000) -> DataFrame:
    """(a, b) with a < b and Euclidean distance at most eps, exactly; see `_in_cells`.

    With separated data few rows are copied; without structure this tends to all pairs, as any exact method does. Null vectors have no pairs.
    """
    id_type = dict(vectors.dtypes)[id_col]
    cells = _in_cells(vectors, id_col, column, eps, anchors, block_rows)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}")

    def compare(table: pa.Table) -> pa.Table:
        ids, chunks = _partners(table, eps)
        found = [(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])) for a, b in chunks]
        kind = table.schema.field("id").type
        left, right = (np.concatenate([f[k] for f in found]) if found else [] for k in (0, 1))
        return pa.table({"a": pa.array(left, kind), "b": pa.array(right, kind)})

    return cells.groupBy("cell", "q", "b").applyInArrow(compare, f"a {id_type}, b {id_type}").distinct()


def components(edges: DataFrame, together: int = 1_000_000, heavy_rows: int = 100_000) -> DataFrame:
    """(node, label): the least node of each connected component of (a, b) links.

    Up to `together` links, a bounded number, are followed in one task. More go through label propagation: every round takes the
    least label among the neighbours and then the label of that label, so long chains shrink fast. Nodes with very many links
    and labels with very many nodes are joined by broadcast (`skew.lookup`). Each round's table is deleted when
    the next is stored.
    """
    kind = dict(edges.dtypes)["a"]
    edges = materialize(edges.select("a", "b").dropna(), "edges")
    if edges.count() <= together:  # from the footers
        found = edges.coalesce(1).mapInArrow(_united, f"node {kind}, label {kind}")
        labels = materialize(found, "labels")
        discard(edges)
        return labels
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    discard(edges)
    links = materialize(both.groupBy("a").agg(F.count(F.lit(1)).alias("load"), F.min("b").alias("m")), "degrees")
    labels = links.select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    loads = links.select(F.col("a").alias("node"), "load")
    old = None
    while True:
        seen = labels.join(loads, "node").select(F.col("node").alias("b"), "label", "load")
        near = skew.lookup(both, seen, "b", heavy_rows=heavy_rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = materialize(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "steps")
        wanted = step.groupBy("label").agg(F.count(F.lit(1)).alias("load"))
        ahead = step.select(F.col("node").alias("label"), F.col("label").alias("next")).join(wanted, "label")
        jumped = materialize(skew.lookup(step, ahead, "label", heavy_rows=heavy_rows).select("node", "was", F.least("label", "next").alias("label")), "labels")
        discard(step)
        labels = jumped.select("node", "label")
        if old is not None:
            discard(old)
        old = jumped
        if jumped.filter("was <> label").isEmpty():
            discard(both), discard(links)
            return labels


def _united(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks])
    names = pc.unique(ends).sort()  # so that the least number is the least node
    a, b = (pc.index_in(table.column(c), names).to_numpy() for c in "ab")
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    label = names.take(pa.array([root(i) for i in range(len(parent))], pa.int64()))
    yield pa.RecordBatch.from_arrays([names, label], ["node", "label"])


def dbscan(vectors: DataFrame, id_col: str, column: str, eps: float = 0.5, min_samples: int = 3, anchors: int = 64, block_rows: int = 20_000) -> DataFrame:
    """(id, cluster_id): least core id of the cluster, -1 for noise.

    A row is a core if it and its partners within eps are `min_samples` or more. A border row joins the cluster of its
    least core. Rows with a null vector are noise. Rows are compared twice, in cells and blocks of bounded size: for the number of
    their partners, and then for links between cores; what comes out of a block is one row per row, never its pairs.
    """
    id_type = dict(vectors.dtypes)[id_col]
    ids = vectors.select(F.col(id_col).alias("id"))
    cells = _in_cells(vectors, id_col, column, eps, anchors, block_rows)
    if cells is None:
        return ids.withColumn("cluster_id", F.lit(-1).cast(id_type))

    def count(table: pa.Table) -> pa.Table:
        found, chunks = _partners(table, eps)
        degree = np.zeros(len(found), dtype=np.int64)
        for a, _ in chunks:
            degree += np.bincount(a, minlength=len(found))
        home = table.column("home").to_numpy()
        return pa.table({"id": table.column("id").filter(pa.array(home)), "d": pa.array(degree[home])})

    degrees = cells.groupBy("cell", "q", "b").applyInArrow(count, f"id {id_type}, d long").groupBy("id").agg((F.sum("d") + 1 >= min_samples).alias("core"))
    degrees = materialize(degrees, "cores")
    marked = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")).join(degrees, "id")
    again = _in_cells(marked, "id", "v", eps, anchors, block_rows, {"core": "boolean"})

    def link(table: pa.Table) -> pa.Table:
        found, chunks = _partners(table, eps)
        core = table.column("core").to_numpy(zero_copy_only=False)
        order = np.argsort(found, kind="stable")
        rank = np.empty(len(found), dtype=np.int64)
        rank[order] = np.arange(len(found))  # the same row may be there twice, as one of its own and as one to compare with
        parent = np.arange(len(found))
        least = np.full(len(found), len(found))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in chunks:
            a, b = a[core[b]], b[core[b]]
            np.minimum.at(least, a, rank[b])
            inner = core[a]
            pairs = np.unique(np.stack([rank[a[inner]], rank[b[inner]]], axis=1), axis=0)
            now = np.array([root(i) for i in pairs[:, 1]], dtype=np.int64) if len(pairs) else pairs[:, 1]
            for i, j in np.unique(np.stack([pairs[:, 0], now], axis=1), axis=0).tolist():
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
        tops = np.array([root(i) for i in rank], dtype=np.int64)
        kind = table.schema.field("id").type
        joined = np.flatnonzero(core & (found[order][tops] != found))
        rim = np.flatnonzero(~core & (least < len(found)))
        a = np.concatenate([found[joined], found[rim]])
        b = np.concatenate([found[order][tops[joined]], found[order][least[rim]]])
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "core": pa.array([True] * len(joined) + [False] * len(rim), pa.bool_())})

    links = materialize(again.groupBy("cell", "q", "b").applyInArrow(link, f"a {id_type}, b {id_type}, core boolean").distinct(), "links")
    labelled = degrees.filter("core").select("id").join(components(links.filter("core").select("a", "b")).withColumnRenamed("node", "id"), "id", "left")
    labelled = materialize(labelled.select("id", F.coalesce("label", "id").alias("label")), "core-labels")
    rim = links.filter("not core").groupBy(F.col("a").alias("border")).agg(F.min("b").alias("id"))
    load = rim.groupBy("id").agg(F.count(F.lit(1)).alias("load"))
    border = skew.lookup(rim, labelled.join(load, "id"), "id").select(F.col("border").alias("id"), "label")
    return ids.join(labelled.unionByName(border), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("cluster_id"))


def hdbscan_labels(x: np.ndarray, min_cluster: int = 5, min_samples: int = 3, method: str = "leaf") -> np.ndarray:
    """Hierarchical density clusters of one group of points; -1 is noise. `method` is 'leaf' or 'eom'."""
    n = len(x)
    if n < max(2, min_cluster):
        return np.full(n, -1)
    d = _distances(x, x)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    return labels_of_tree(n, spanning_tree(d, core), min_cluster, method)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dimension by dimension, so that a pair's distance is the same number whatever it is computed with."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def spanning_tree(d: np.ndarray, core: np.ndarray) -> list[tuple[float, float, int, int]]:
    """The least spanning tree by mutual reachability, ties by distance, edge by edge from point 0: (reach, distance, a, b)."""
    n = len(d)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, near, link, used, edges = reach[0].copy(), d[0].copy(), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), []
    used[0] = True
    for _ in range(n - 1):
        open_ = np.where(used, np.inf, best)
        tied = np.flatnonzero(open_ == open_.min())
        j = int(tied[np.argmin(near[tied])])
        edges.append((float(best[j]), float(near[j]), int(link[j]), j))
        used[j] = True
        closer = ~used & ((reach[j] < best) | (reach[j] == best) & (d[j] < near))
        best[closer], near[closer], link[closer] = reach[j][closer], d[j][closer], j
    return edges


def labels_of_tree(n: int, edges: list[tuple[float, float, int, int]], min_cluster: int, method: str, weights: list[int] | None = None, core: list[float] | None = None) -> np.ndarray:
    """Clusters from the n - 1 edges of a spanning tree; the work grows as n log n.

    With `weights`, a node stands for so many equal points, which are joined among themselves at its `core` distance, before any other.
    """
    edges = sorted(edges)
    # merge tree: nodes n.. are unions
    parent, size, kids, height = list(range(2 * n - 1)), [*(weights or [1] * n), *[0] * (n - 1)], {}, {}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, (w, _, a, b) in enumerate(edges):
        ra, rb, new = root(a), root(b), n + k
        parent[ra] = parent[rb] = new
        size[new], kids[new], height[new] = size[ra] + size[rb], (ra, rb), w
    # condensed tree: a split counts if both sides are large enough
    clusters, points = {0: None}, {}
    birth, death_sum, below = {0: 0.0}, {0: 0.0}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            points[node] = c
            if size[node] > 1:  # its points leave c together
                death_sum[c] += size[node] * ((1.0 / core[node] if core[node] > 0 else 1e12) - birth[c])
            continue
        lam = 1.0 / height[node] if height[node] > 0 else 1e12
        a, b = kids[node]
        if size[a] >= min_cluster and size[b] >= min_cluster:
            for child in (a, b):
                new = len(clusters)
                clusters[new], birth[new], death_sum[new], below[new] = c, lam, 0.0, []
                below[c].append(new)
                death_sum[c] += size[child] * (lam - birth[c])
                stack.append((child, new))
        else:
            for child in (a, b):
                if size[child] < min_cluster:
                    death_sum[c] += size[child] * (lam - birth[c])
                    left = [child]
                    while left:
                        v = left.pop()
                        if v < n:
                            points[v] = -1 - c  # fell out of c
                        else:
                            left.extend(kids[v])
                else:
                    stack.append((child, c))
    chosen = {c for c in clusters if not below[c] and c != 0}
    if method == "eom":
        value = dict(death_sum)
        for c in sorted(clusters, reverse=True):
            if below[c] and c != 0:
                under = sum(value[k] for k in below[c])
                if value[c] >= under:
                    todo = list(below[c])
                    while todo:
                        k = todo.pop()
                        chosen.discard(k)
                        todo.extend(below[k])
                    chosen.add(c)
                else:
                    value[c] = under
    labels = np.full(n, -1)
    names = {c: i for i, c in enumerate(sorted(chosen))}
    for v, c in points.items():
        c = c if c >= 0 else -1 - c
        while c is not None and c not in names:
            c = clusters[c]
        if c is not None:
            labels[v] = names[c]
    return labels


def hdbscan(
    vectors: DataFrame, group: str, id_col: str, column: str, min_cluster: int = 5, min_samples: int = 3, method: str = "leaf", together: int = 5_000, block_rows: int = 2_000,
) -> DataFrame:
    """(group, id, cluster_id) with clusters within each group, -1 for noise and for null vectors.

    Groups of up to `together` rows are clustered in one task each. For larger ones distances to the nearest neighbours and the
    least spanning tree of the mutual reachability distances are made in blocks of distinct vectors (`_large_groups`), with the same
    result up to ties; rows of equal vectors are one point with a weight, so copies cost nothing. What one task then gets is the
    tree, an id and four numbers a point, not the vectors. Ids are unique within a group.
    """
    types = dict(vectors.dtypes)
    schema = f"`{group}` {types[group]}, `{id_col}` {types[id_col]}, cluster_id int"
    slim = vectors.select(group, id_col, column)
    sizes = slim.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > together), "large-groups")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, ignore_index=True)
        ok = pdf[column].notna().to_numpy()
        labels = np.full(len(pdf), -1)
        if ok.any():
            labels[ok] = hdbscan_labels(np.stack(pdf.loc[ok, column].to_list()).astype(np.float64), min_cluster, min_samples, method)
        return pd.DataFrame({group: pdf[group], id_col: pdf[id_col], "cluster_id": labels.astype("int32")})

    if large.isEmpty():
        return slim.groupBy(group).applyInPandas(run, schema)
    same = F.col(f"{group}").eqNullSafe(F.col("_big"))
    big = F.broadcast(large.select(F.col(group).alias("_big"), "_n"))  # one row per large group
    small = slim.join(big, same, "left_anti").groupBy(group).applyInPandas(run, schema)
    return small.unionByName(_large_groups(slim.join(big, same), group, id_col, column, min_cluster, min_samples, method, block_rows, schema))


def _large_groups(rows: DataFrame, group: str, id_col: str, column: str, min_cluster: int, min_samples: int, method: str, block_rows: int, schema: str) -> DataFrame:
    placed = rows.filter(F.col(column).isNotNull()).select(
        F.col(group).alias("_group"), F.col(id_col).alias("_id"), F.xxhash64(F.lit("group"), F.col(group)).alias("g"), F.transform(F.col(column).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")
    )
    placed = placed.withColumn("node", F.xxhash64("g", "v"))  # 0 was added as -0 is 0 but has another hash
    points = materialize(placed.groupBy("g", "node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight")), "points")
    sizes = points.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    nodes = points.join(F.broadcast(sizes), "g")  # one row per large group
    nodes = materialize(nodes.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))), "nodes")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")

    def paired(df: DataFrame, *columns: str) -> DataFrame:
        """Every row in all pairs of its block with another, the lower block first."""
        placed = df.select("g", "own", every, *columns)
        return placed.select("g", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *columns)

    def nearest(part: pa.Table) -> pa.Table:
        x, own, node = np.array(part.column("v").to_pylist()), part.column("own").to_numpy(), part.column("node")
        weight = part.column("weight").to_numpy()
        one, two = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        out_node, out_far = [], []
        for a, b in ((one, two),) if own.min() == own.max() else ((one, two), (two, one)):
            d = _distances(x[a], x[b])
            if a is one and own.min() == own.max():
                np.fill_diagonal(d, 0)
            d = np.repeat(d, np.minimum(weight[b], min_samples + 1), axis=1)  # a point is as near as often as it has rows
            k = min(min_samples + 1, d.shape[1])
            out_far += np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1).tolist()
            out_node += node.take(pa.array(a)).to_pylist()
        return pa.table({"node": pa.array(out_node, pa.int64()), "far": pa.array(out_far, pa.list_(pa.float64()))})

    lists = paired(nodes, "node", "v", "weight").groupBy("g", "p", "q").applyInArrow(nearest, "node long, far array<double>")
    # the row itself, at 0, is one of the list, as it is in the matrix of a small group
    merged = F.sort_array(F.flatten(F.collect_list("far")))
    core = lists.groupBy("node").agg(F.element_at(F.slice(merged, 1, min_samples + 1), -1).alias("core"))
    nodes = materialize(nodes.join(core, "node"), "cored")

    def tree(part: pa.Table) -> pa.Table:
        x, c, node = np.array(part.column("v").to_pylist()), part.column("core").to_numpy(), part.column("node").to_numpy()
        edges = spanning_tree(_distances(x, x), c)
        w, d, a, b = zip(*edges) if edges else ((), (), (), ())
        g = part.column("g")[0].as_py()
        return pa.table({
            "g": pa.array([g] * len(w), pa.int64()), "w": pa.array(w, pa.float64()), "d": pa.array(d, pa.float64()), "a": pa.array(node[list(a)], pa.int64()), "b": pa.array(node[list(b)], pa.int64()),
        })

    # every pair of rows is in some pair of blocks, so the trees of these hold the tree of the whole group
    edges = paired(nodes, "node", "v", "core").groupBy("g", "p", "q").applyInArrow(tree, "g long, w double, d double, a long, b long")
    edges = edges.select("g", "w", "d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("g", "a", "b").agg(F.min("w").alias("w"), F.min("d").alias("d"))
    kept = _least_tree(materialize(edges, "block-trees"))

    def label(ids: pa.Table, links: pa.Table) -> pa.Table:
        order = np.argsort(ids.column("node").to_numpy())
        node, weight, core = (ids.column(c).to_numpy()[order] for c in ("node", "weight", "core"))
        a, b = (np.searchsorted(node, links.column(c).to_numpy()) for c in "ab")
        n = len(node)
        found = np.full(n, -1)
        if weight.sum() >= max(2, min_cluster):
            edges = list(zip(links.column("w").to_pylist(), links.column("d").to_pylist(), a.tolist(), b.tolist()))
            found = labels_of_tree(n, edges, min_cluster, method, weight.tolist(), core.tolist())
        return pa.table({"node": pa.array(node, pa.int64()), "cluster_id": pa.array(found, pa.int32()), "load": pa.array(weight, pa.int64())})

    labels = nodes.select("g", "node", "weight", "core").groupBy("g").cogroup(kept.groupBy("g")).applyInArrow(label, "node long, cluster_id int, load long")
    known = skew.lookup(placed.select("_group", "_id", "node"), materialize(labels, "point-labels"), "node").select(F.col("_group").alias(group), F.col("_id").alias(id_col), "cluster_id")
    unplaced = rows.filter(F.col(column).isNull()).select(group, id_col, F.lit(-1).alias("cluster_id"))
    return known.unionByName(unplaced).to(StructType.fromDDL(schema))


def _least_tree(edges: DataFrame) -> DataFrame:
    """The least spanning forest of (g, a, b, w, d) edges: each round every component takes its least edge by w, then d, then its ends."""
    kept = None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "forest")
    left = edges
    while True:
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("ca")), labels.select(F.col("node").alias("b"), F.col("label").alias("cb"))
        left = materialize(left.select("g", "w", "d", "a", "b").join(la, "a").join(lb, "b").filter("ca <> cb"), "open-edges")
        if left.isEmpty():
            return kept if kept is not None else edges
        ends = F.explode(F.array("ca", "cb")).alias("c")
        best = left.select(ends, F.struct("w", "d", "a", "b", "g", "ca", "cb").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        chosen = materialize(best.select("e.*").distinct(), "chosen")
        kept = chosen.select("g", "w", "d", "a", "b") if kept is None else kept.unionByName(chosen.select("g", "w", "d", "a", "b"))
        joined = components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
        labels = materialize(labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "forest")


def wide(df: DataFrame, column: str, width: int, prefix: str = "emb_") -> DataFrame:
    """The array column as columns emb_000, emb_001 and so on, for exchange."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(F.col(column), F.lit(i)).alias(f"{prefix}{i:03d}") for i in range(width)])
