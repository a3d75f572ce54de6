"""The most similar vectors of every vector, by a hierarchical k-means tree."""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.runtime import discard, materialize

SAMPLE = 20_000  # vectors that a tree is fitted on, at most; also those of a leaf that is split further
LEAF_ROWS = 4_000  # vectors in a leaf, on average: large leaves, as visits cost shuffle and comparing is cheap
LEAST_IN_LEAF = 12  # sampled vectors in a leaf; bounds a tree, and what is sent to the tasks
BRANCHES = 8
LEVELS = 4  # times that leaves are split; enough for more rows than a long counts
TARGET = 0.96  # recall that the number of leaves to visit is calibrated for
PROBED = 400  # sampled vectors used for that
TASK_ROWS = 100_000  # vectors of one side that are compared in one task
COPIES = 4  # of every vector that are shuffled at a time
KNOWN = 1 << 20  # digests of vectors that a task remembers to find equal ones


def unit_rows(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and these vectors at unit length.

    Usable means: not null, `width` numbers, none of them null, NaN or infinite, not all zero.
    """
    lengths = np.diff(values.offsets.to_numpy())
    ok = values.is_valid().to_numpy(zero_copy_only=False) & (lengths == width)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.empty((0, width), np.float32)
    kept = values.take(pa.array(at)).flatten()
    flat = kept.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
    norms = np.sqrt(np.einsum("ij,ij->i", flat, flat, dtype=np.float64))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], (flat[good] / norms[good, None]).astype(np.float32)


class Tree:
    """Nodes of a k-means tree: unit centroids, children, and leaf numbers."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids, self.children, self.leaf_of = [], [], []
        self.leaves = 0
        self._grow(sample, max(leaf_size, LEAST_IN_LEAF), rng, sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1]))
        self.matrix = np.asarray(self.centroids, dtype=np.float32)
        del self.centroids

    def _grow(self, rows: np.ndarray, leaf_size: int, rng, centre: np.ndarray) -> int:
        me = len(self.children)
        norm = np.linalg.norm(centre)
        self.centroids.append(centre / norm if norm > 0 else centre)
        self.children.append([])
        self.leaf_of.append(-1)
        parts = split(rows, min(BRANCHES, math.ceil(len(rows) / leaf_size)), rng) if len(rows) > leaf_size else []
        if len(parts) < 2:
            self.leaf_of[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(p, leaf_size, rng, p.mean(axis=0)) for p in parts]
        return me

    def graft(self, leaf: int, other: Tree) -> None:
        """Puts `other` in the place of a leaf; its first leaf gets the number of that leaf."""
        at, offset = self.leaf_of.index(leaf), len(self.children) - 1
        self.matrix = np.concatenate([self.matrix, other.matrix[1:]])
        number = lambda n: -1 if n < 0 else leaf if n == 0 else self.leaves + n - 1
        self.children[at], self.leaf_of[at] = [c + offset for c in other.children[0]], number(other.leaf_of[0])
        self.children += [[c + offset for c in own] for own in other.children[1:]]
        self.leaf_of += [number(n) for n in other.leaf_of[1:]]
        self.leaves += other.leaves - 1

    def visit(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The first `count` leaves of each row, best bin first: a queue of nodes by similarity."""
        count = min(count, self.leaves)
        out = np.empty((len(rows), count), dtype=np.int32)
        children, leaf_of = self.children, self.leaf_of
        step = max(1, (1 << 23) // len(children))
        for i in range(len(rows)):
            if i % step == 0:
                similar = rows[i : i + step] @ self.matrix.T
            row = similar[i % step]
            queue, found = [(-2.0, 0)], 0
            while found < count:
                node = heapq.heappop(queue)[1]
                if leaf_of[node] >= 0:
                    out[i, found] = leaf_of[node]
                    found += 1
                else:
                    for child in children[node]:
                        heapq.heappush(queue, (-float(row[child]), child))
        return out


def split(rows: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    """Spherical k-means; fewer parts if rows coincide."""
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        for j in range(k):
            own = rows[nearest == j]
            if len(own):
                mean = own.mean(axis=0)
                norm = np.linalg.norm(mean)
                centres[j] = mean / norm if norm > 0 else mean
    nearest = np.argmax(rows @ centres.T, axis=1)
    return [rows[nearest == j] for j in range(k) if (nearest == j).any()]


def calibrate(tree: Tree, sample: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit so that `target` of the sample's true neighbours are found.

    Neighbours within the sample lie farther off than those in all data, so the number errs to the high side.
    """
    if tree.leaves == 1 or len(sample) <= k + 1:
        return tree.leaves
    step = max(1, len(sample) // PROBED)
    asked = sample[::step]
    home = tree.visit(sample, 1)[:, 0]
    order = tree.visit(asked, tree.leaves)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(tree.leaves, dtype=order.dtype)[None, :].repeat(len(asked), 0), axis=1)
    similar = asked @ sample.T
    similar[np.arange(len(asked)), np.arange(len(asked)) * step] = -2
    best = np.argpartition(-similar, k, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int = 384,
    k: int = 10,
    target: float = TARGET,
    sample_rows: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    least: float = -2.0,
) -> DataFrame:
    """(id, neighbour, similarity, place): up to k most similar others of every usable vector, by cosine, that are `least` similar or more.

    Vectors that are null, of another length, all zero or hold a null, NaN or infinite value have no rows and are
    no neighbours. Ties are broken by the smaller id. ids must be unique longs. Other columns are
    ignored. With fewer than k + 1 usable vectors all others come out.

    A k-means tree is fitted on at most `sample_rows` vectors, drawn by the hash of their ids from the whole table. A leaf of more
    than twice `leaf_rows` vectors gets a tree of its own in the place of the leaf, fitted on a sample of its vectors, and so on, so leaves don't
    grow with the table. Every vector is put into its nearest leaf and compared, in 16-bit floats, with all vectors of
    the leaves it visits; these are as many as find `target` of the true neighbours, of `least` similarity, of PROBED vectors, which are searched for in the whole
    table. Equal vectors of one input partition are compared once and expanded at the end, so a large group of copies costs no comparisons
    among themselves. Leaves with more than TASK_ROWS rows on a side are split over tasks and their results merged. Vectors are
    stored once; copies of them for the visits are shuffled for a part of the leaves at a time (COPIES per vector), so disk doesn't grow with the visits.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    total = vectors.count()  # from the footers; it only sets the sample's share and the size of leaves
    placed, rows = _in_leaves(slim, total, k, width, target, sample_rows, leaf_rows, least)
    loads = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("place") == 0, 1)).alias("held"))
    heavy = loads.filter(f"asked > {TASK_ROWS} or held > {TASK_ROWS}").select(
        "leaf", F.ceil(F.col("asked") / TASK_ROWS).alias("nq"), F.greatest(F.ceil(F.col("held") / TASK_ROWS), F.lit(1)).alias("nb")
    )
    heavy = materialize(heavy, "heavy")
    split_any = not heavy.isEmpty()
    visits = rows.agg(F.max("place")).first()[0]
    turns = max(1, -(-((visits or 0) + 1) // COPIES))
    partial = None
    for turn in range(turns):
        own = rows if turns == 1 else rows.filter(F.pmod(F.xxhash64("leaf"), F.lit(turns)) == turn)
        found = materialize(_compared(own, heavy if split_any else None, k, width, least), "compared")
        partial = found if partial is None else partial.unionByName(found)
        if turns > 1:  # the shuffled vectors go before those of the next turn come
            del own, found
            gc.collect()
            vectors.sparkSession._jvm.System.gc()
    pairs = F.transform(F.arrays_zip("others", "sims"), lambda p: F.struct((-p["sims"]).alias("far"), p["others"].alias("other")))
    best = partial.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    best = materialize(best, "best")  # read more than once below
    copies = materialize(placed.filter("v is null").select("id", "node"), "copies")
    if not copies.isEmpty():
        best = _expand(best, copies, k)
    return best.select(
        F.col("node").alias("id"), F.posexplode("best").alias("place", "p")
    ).select("id", F.col("p.other").alias("neighbour"), (-F.col("p.far")).alias("similarity"), (F.col("place") + 1).alias("place"))


def _compared(rows: DataFrame, heavy: DataFrame | None, k: int, width: int, least: float) -> DataFrame:
    """(node, others, sims) for every visit in `rows`, the best of each leaf, or of each part of a `heavy` one."""
    asked = rows.select("leaf", F.lit(False).alias("held"), "node", "v", "place")
    if heavy is not None:
        spread = rows.join(F.broadcast(heavy), "leaf", "left").fillna(1, ["nq", "nb"])  # fewer rows than TASK_ROWS goes into all
        part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        ask = spread.select("leaf", part("nq").alias("q"), every("nb").alias("b"), F.lit(False).alias("held"), "node", "v", "place")
        hold = spread.filter("place = 0").select("leaf", every("nq").alias("q"), part("nb").alias("b"), F.lit(True).alias("held"), "node", "v", "place")
        grouped = ask.unionByName(hold)
        keys = ["leaf", "q", "b"]
    else:
        grouped, keys = asked, ["leaf"]  # a vector in its own leaf is both asked and held
    return grouped.groupBy(*keys).applyInArrow(_compare(k, width, least), "node long, others array<long>, sims array<float>")


def _in_leaves(slim: DataFrame, total: int, k: int, width: int, target: float, sample_rows: int, leaf_rows: int, least: float = -2.0) -> tuple[DataFrame, DataFrame]:
    """(id, node, leaves, v) of all usable vectors, and (node, v, place, leaf) of every visit; place is 0 in the leaf that holds the vector."""
    sample = _draw(slim, total, sample_rows, width)
    tree = Tree(sample, math.ceil(leaf_rows * len(sample) / max(1, total)))
    if total > 2 * leaf_rows:
        for _ in range(LEVELS):
            if not _split_leaves(slim, tree, leaf_rows, sample_rows, width):
                break
    visits = _calibrate(slim, tree, sample[:: max(1, len(sample) // PROBED)], k, width, target, least)
    placed = materialize(
        slim.mapInArrow(_place(tree, visits, width), "id long, node long, leaves array<int>, v binary"), "placed"
    )
    rows = placed.filter("v is not null").select("node", "v", F.posexplode("leaves").alias("place", "leaf")).withColumn("leaf", F.col("leaf").cast("long"))
    return placed, rows


def _calibrate(slim: DataFrame, tree: Tree, asked: np.ndarray, k: int, width: int, target: float, least: float) -> int:
    """Leaves to visit so that `target` of the true neighbours of the `asked` vectors, in the whole table and of `least` similarity, are found."""
    if tree.leaves == 1 or not len(asked):
        return tree.leaves
    order = tree.visit(asked, tree.leaves)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(tree.leaves, dtype=order.dtype)[None, :].repeat(len(asked), 0), axis=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, ranks = np.full((len(asked), k + 1), -3, np.float32), np.zeros((len(asked), k + 1), np.int32)
        for batch in batches:
            _, unit = unit_rows(batch.column(1), width)
            if not len(unit):
                continue
            similar = asked @ unit.T
            n = min(k + 1, len(unit))
            near = np.argpartition(-similar, n - 1, axis=1)[:, :n]
            home, found = np.zeros(len(unit), np.int32), np.take_along_axis(similar, near, axis=1)
            some = np.unique(near[(found >= least) & (found > sims[:, -1:])])
            home[some] = tree.visit(unit[some], 1)[:, 0]
            sims = np.concatenate([sims, found], axis=1)
            ranks = np.concatenate([ranks, np.take_along_axis(rank, home[near], axis=1)], axis=1)
            best = np.argsort(-sims, axis=1)[:, : k + 1]
            sims, ranks = np.take_along_axis(sims, best, axis=1), np.take_along_axis(ranks, best, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), k + 1)), pa.array(sims.ravel()), pa.array(ranks.ravel())], ["i", "s", "r"])

    pair = F.struct((-F.col("s")).alias("far"), "r")
    best = slim.mapInArrow(search, "i long, s float, r int").filter(F.col("s") >= max(least, -2.0)).groupBy("i").agg(F.slice(F.sort_array(F.collect_list(pair)), 2, k).alias("best"))  # the first is itself
    needed = sorted(r for row in best.select("best.r").collect() for r in row.r)  # at most k of each asked vector
    if len(needed) < len(asked) // 10:  # too few to tell by
        return calibrate(tree, asked, k, target)
    return needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)] + 1


def _draw(slim: DataFrame, total: int, size: int, width: int) -> np.ndarray:
    """`size` usable vectors at most, those of the least hashes of their ids, whatever the table's order."""
    span = 1 << 30
    mark = F.pmod(F.xxhash64("id"), F.lit(span))
    drawn = slim.select(mark.alias("mark"), "v").filter(F.col("mark") < min(span, math.ceil(1.25 * span * size / max(1, total)))).toArrow()
    if not drawn.num_rows:
        return np.empty((0, width), np.float32)
    at, unit = unit_rows(_one_array(drawn.column("v")), width)
    order = np.argsort(drawn.column("mark").to_numpy()[at], kind="stable")
    return unit[order[:size]]


def _split_leaves(slim: DataFrame, tree: Tree, leaf_rows: int, sample_rows: int, width: int) -> bool:
    """Puts trees of their own in the place of the leaves of `tree` with too many vectors; False if there are none that can be split."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = unit_rows(batch.column(1), width)
            if len(at):
                leaf = tree.visit(unit, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(leaf)], ["id", "leaf"])

    homes = materialize(slim.mapInArrow(home, "id long, leaf int"), "homes")
    big = {r.leaf: r.held for r in homes.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > 2 * leaf_rows).toLocalIterator()}  # fewer than leaves
    if not big:
        discard(homes)
        return False
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for leaf, held in big.items() for x in (leaf, float(min(span * LEAST_IN_LEAF / leaf_rows, span * sample_rows / held)))])
    within = homes.filter(F.pmod(F.xxhash64("id"), F.lit(span)) < F.try_element_at(share, F.col("leaf")))

    def fit(table: pa.Table) -> pa.Table:
        _, unit = unit_rows(_one_array(table.column("v")), width)
        own = Tree(unit, LEAST_IN_LEAF)
        kept = own.leaves > 1  # equal or nearly equal vectors, which no tree tells apart
        return pa.table({"leaf": pa.array([table.column("leaf")[0].as_py()] if kept else [], pa.int32()), "tree": pa.array([pickle.dumps(own)] if kept else [], pa.binary())})

    grafts = slim.join(within, "id").select("leaf", "v").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary")
    grown = False
    for r in grafts.toLocalIterator():
        tree.graft(r.leaf, pickle.loads(r.tree))
        grown = True
    discard(homes)
    return grown


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, width).astype(np.float32)


def _one_array(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0)


def _place(tree: Tree, visits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}  # of digests, and no more than KNOWN: copies that aren't recognised are compared like others
        for batch in batches:
            if len(first) > KNOWN:
                first.clear()
            at, unit = unit_rows(batch.column(1), width)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            half = unit.astype(np.float16)
            raw = [half[i].tobytes() for i in range(len(half))]
            node = [first.setdefault(hashlib.blake2b(r, digest_size=16).digest(), int(i)) for r, i in zip(raw, ids)]
            leaves = tree.visit(unit, visits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(node, pa.int64()), pa.array(list(leaves), pa.list_(pa.int32())),
                    pa.array([r if n == i else None for r, n, i in zip(raw, node, ids)], pa.binary()),
                ],
                ["id", "node", "leaves", "v"],
            )

    return run


def _compare(k: int, width: int, least: float = -2.0):
    def run(table: pa.Table) -> pa.Table:
        held = table.column("held").to_numpy()
        place = table.column("place").to_numpy()
        split_sides = bool(held.any())
        everything = _matrix(table.column("v"), width)
        nodes = table.column("node").to_numpy()
        base_at = np.flatnonzero(held) if split_sides else np.flatnonzero(place == 0)
        ask_at = np.flatnonzero(~held)
        base, base_ids = everything[base_at], nodes[base_at]
        out_node, out_ids, out_sims = [], [], []
        if len(base):
            order = np.argsort(base_ids, kind="stable")  # so that equal similarities come in id order
            base, base_ids = base[order], base_ids[order]
            for lo in range(0, len(ask_at), 512):
                rows = ask_at[lo : lo + 512]
                similar = everything[rows] @ base.T
                own = np.searchsorted(base_ids, nodes[rows])
                own = np.minimum(own, len(base_ids) - 1)
                mine = base_ids[own] == nodes[rows]
                similar[np.flatnonzero(mine), own[mine]] = -3
                n = min(k, len(base_ids))
                if least > -2:
                    kth = np.full(len(rows), least, np.float32)
                elif n < len(base_ids):
                    kth = np.partition(similar, len(base_ids) - n, axis=1)[:, len(base_ids) - n]
                for i, r in enumerate(rows):
                    row = similar[i]
                    if least > -2 or n < len(base_ids):
                        near = np.flatnonzero(row >= kth[i])
                        near = near[np.argsort(-row[near], kind="stable")][:n]
                    else:
                        near = np.argsort(-row, kind="stable")
                    near = near[row[near] > -2]
                    out_node.append(nodes[r])
                    out_ids.append(base_ids[near])
                    out_sims.append(row[near])
        return pa.table(
            {"node": pa.array(out_node, pa.int64()), "others": pa.array(out_ids, pa.list_(pa.int64())), "sims": pa.array(out_sims, pa.list_(pa.float32()))}
        )

    return run


def _expand(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbour lists of all ids, where `copies` are ids whose vector equals that of their node.

    A node's least k + 1 ids are all that can be in a list, so no group of copies is collected.
    """
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = _top_ids(_top_ids(salted, ["node", "salt"], k + 1), ["node"], k + 1)
    own = least.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("more"))
    own = materialize(own, "own")
    # neighbours stand for all their copies
    opened = best.select("node", F.explode_outer("best").alias("b")).select("node", F.col("b.far").alias("far"), F.col("b.other").alias("other"))
    grown = opened.join(own.select(F.col("node").alias("other"), "more"), "other", "left").select(
        "node", "far", F.explode(F.concat(F.array("other"), F.coalesce("more", F.expr("array()")))).alias("other")
    ).filter("other is not null")
    lists = grown.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "other"))), 1, k + 1).alias("best"))
    lists = best.select("node").join(lists, "node", "left").join(own, "node", "left").select(
        "node", F.coalesce("best", F.expr("cast(array() as array<struct<far: float, other: bigint>>)")).alias("best"),
        F.concat(F.array("node"), F.coalesce("more", F.expr("array()"))).alias("family"), F.col("more").isNotNull().alias("has")
    )
    lists = materialize(lists, "lists")

    def ranked(me):
        kin = F.transform(F.filter("family", lambda o: o != me), lambda o: F.struct(F.lit(-1.0).cast("float").alias("far"), o.alias("other")))
        return F.slice(F.array_sort(F.concat(F.when(F.col("has"), kin).otherwise(F.expr("cast(array() as array<struct<far: float, other: bigint>>)")), "best")), 1, k)

    nodes = lists.select("node", ranked(F.col("node")).alias("best"))
    others = copies.join(lists, "node").select(F.col("id").alias("node"), ranked(F.col("id")).alias("best"))
    return nodes.unionByName(others)


def _top_ids(salted: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("id")
    return salted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("node", "id")


def exact(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 384, k: int = 10, block: int = 2_000) -> DataFrame:
    """(id, neighbour, similarity) by brute force for a stated set of queries, in blocks against all rows."""
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    n = asked.count()
    blocks = -(-n // block)
    out = None
    for b in range(max(1, blocks)):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == b).toArrow()
        at, unit = unit_rows(_one_array(rows.column("v")), width) if rows.num_rows else ([], np.empty((0, width), np.float32))
        ids = rows.column("id").to_numpy()[at] if rows.num_rows else np.empty(0, np.int64)
        part = slim.mapInArrow(_brute(ids, unit, width, k), "id long, neighbour long, similarity float")
        out = part if out is None else out.unionByName(part)
    pair = F.struct((-F.col("similarity")).alias("far"), "neighbour")
    return out.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(pair)), 1, k).alias("best")).select("id", F.explode("best").alias("p")).select(
        "id", "p.neighbour", (-F.col("p.far")).alias("similarity")
    )


def _brute(ids: np.ndarray, unit: np.ndarray, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column(1), width)
            if not len(at) or not len(ids):
                continue
            other = batch.column(0).to_numpy(zero_copy_only=False)[at]
            similar = unit @ rows.T
            similar[ids[:, None] == other[None, :]] = -3
            n = min(k, similar.shape[1])
            near = np.argpartition(-similar, n - 1, axis=1)[:, :n]
            sims = np.take_along_axis(similar, near, axis=1).ravel()
            good = sims > -2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)[good]), pa.array(other[near].ravel()[good]), pa.array(sims[good], pa.float32())],
                ["id", "neighbour", "similarity"],
            )

    return run
