"""Clusters of texts that say the same, by density in a grid of quantised phrase features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators.density import components
from loomspark.operators.skew import lookup
from loomspark.runtime import materialize, scratch_scope

WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
CLAUSE = r"[.,;:!?()\n\r]+|\s[-–—]+(?=\s|$)"
FRAME_SHARE = 0.15  # words in more texts than this are grammar, unless they come with certain others
TESTED_SHARE = 0.02  # phrases in more texts than this must show that they belong to a topic
CLAUSE_WORDS = 24  # words after which a clause without signs is cut
SPAN = 10  # clauses, one after the other, whose phrases make cells together: a need is told in no more
DIMENSIONS = 3  # phrases, of different clauses, that make a cell of the grid; texts of fewer clauses have cells of their own
DENSITY = 4.0  # log-likelihood, over that of one text among USUAL, by which a cell's count must exceed chance
STRANGERS = 0.0005, 0.0001  # texts of other needs that may be expected in a cell, in all and by member; common phrases make cells of four
USUAL = 600  # fixed, so that a cell is judged alike in a table of any size
ALTERNATES = 3  # clusters in which two words must stand for each other to count as one


def distinct_messages(piles: DataFrame) -> DataFrame:
    """(message_id, text) from piles of texts and message_ids: one row per id, the least text if they differ.

    Null ids, null, empty and blank texts are left out, as are texts without an id.
    """
    rows = piles.select(F.explode(F.arrays_zip("message_ids", "texts")).alias("p")).select(
        F.col("p.message_ids").alias("message_id"), F.col("p.texts").alias("text")
    )
    return rows.filter("message_id is not null and trim(text) <> ''").groupBy("message_id").agg(F.min("text").alias("text"))


def _clauses(text: Column) -> Column:
    """The words of each clause, in lower case; clauses of more than CLAUSE_WORDS words are cut."""
    found = F.transform(F.split(F.lower(text), CLAUSE), lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    pieces = F.transform(found, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CLAUSE_WORDS).cast("int")), lambda i: F.slice(c, i * CLAUSE_WORDS + 1, F.lit(CLAUSE_WORDS))))
    return F.when(F.exists(found, lambda c: F.size(c) > CLAUSE_WORDS), F.flatten(F.transform(pieces, lambda p: p))).otherwise(found)


def _phrases(clauses: Column, frame: list[str]) -> Column:
    """Per text (phrase, clause number): neighbouring content words, or the only one, of every clause."""
    content = F.transform(clauses, lambda c: F.filter(c, lambda w: ~w.isin(frame))) if frame else clauses  # a hash set for each task

    def of_clause(c, i):
        pairs = F.transform(
            F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c)).alias("b")),
            lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("phrase"), i.alias("clause")),
        )
        single = F.array(F.struct(F.get(c, F.lit(0)).alias("phrase"), i.alias("clause")))
        none = F.expr("cast(array() as array<struct<phrase: string, clause: int>>)")
        return F.when(F.size(c) > 1, pairs).when(F.size(c) == 1, single).otherwise(none)

    return F.flatten(F.transform(content, of_clause))


def _renamed(spots: DataFrame, same: DataFrame) -> DataFrame:
    """`spots` with every word of their phrases in the form that `same` (word, label) gives it.

    Words are looked up once per phrase, and phrases then per spot, so a frequent phrase is no one task's work.
    """
    phrases = materialize(spots.groupBy("phrase").agg(F.count(F.lit(1)).alias("load")), "phrase-loads")
    words = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "word"))
    named = words.join(same, "word").groupBy("phrase").agg(F.map_from_entries(F.collect_list(F.struct("at", "label"))).alias("labels"))
    name = F.array_join(F.transform(F.split("phrase", " "), lambda w, i: F.coalesce(F.try_element_at("labels", i), w)), " ")
    table = phrases.join(named, "phrase", "left").select("phrase", F.when(F.col("labels").isNull(), F.col("phrase")).otherwise(name).alias("name"), "load")
    return lookup(spots, materialize(table, "phrase-names"), "phrase").groupBy("message_id", F.col("name").alias("phrase")).agg(F.min("clause").alias("clause"))


def _common_words(texts: DataFrame, n: int) -> list[str]:
    """Words in more than FRAME_SHARE of the texts that don't draw certain other words with them.

    There are fewer than words-per-text / FRAME_SHARE of them, whatever the size of the input.
    """
    often = _often(texts, FRAME_SHARE * n / 2)
    tested = {w: k for w, k in often.items() if k > FRAME_SHARE * n}
    found = F.flatten(F.transform("clauses", lambda c, i: F.transform(F.array_distinct(c), lambda w: F.struct(w.alias("phrase"), i.alias("clause")))))
    return sorted(set(tested) - _bound(texts.select("clauses", found.alias("p")), tested, often, n))


def _often(texts: DataFrame, least: float) -> dict[str, int]:
    """Words in more than `least` texts; a fixed share of the texts, so their number is bounded."""
    words = texts.select(F.explode(F.array_distinct(F.flatten("clauses"))).alias("w")).groupBy("w").count()
    return {r.w: r[1] for r in words.filter(F.col("count") > least).toLocalIterator()}


def _bound(rows: DataFrame, items: dict[str, int], often: dict[str, int], n: int) -> set[str]:
    """Items with a word, in other clauses, in half of their texts and twice as often as elsewhere.

    A phrase of a topic has such words, however large the topic is; a turn of phrase has not. Words that
    hardly ever stand more than one clause away don't count: they belong to the same turn of phrase.
    `rows` has the clauses and the phrases with their clause. Both vocabularies are bounded (see
    the callers), so every task counts into two matrices and only their cells are shuffled.
    """
    if not items or not often:
        return set()
    counts = rows.mapInArrow(_count_partners(items, often), "item string, w string, both long, far long").groupBy("item", "w").agg(
        F.sum("both").alias("both"), F.sum("far").alias("far")
    )
    # at most one row per item and partner
    return {
        r.item for r in counts.filter("far >= 0.25 * both").toLocalIterator()
        if r.both >= 0.5 * items[r.item] and r.both / items[r.item] >= 2 * often[r.w] / n
    }


def _count_partners(items: dict[str, int], often: dict[str, int]):
    item_set, word_set = pa.array(list(items), pa.string()), pa.array(list(often), pa.string())
    least = 1 << 20  # texts of a piece times words, so that the matrices stay small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(item_set), len(word_set)), dtype=np.int64)
        far = np.zeros_like(both)
        step = max(1, least // len(word_set))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                _add_partners(batch.slice(lo, step), item_set, word_set, both, far)
        i, w = np.nonzero(both)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [item_set.take(pa.array(i)), word_set.take(pa.array(w)), pa.array(both[i, w]), pa.array(far[i, w])], ["item", "w", "both", "far"]
            )

    return run


def _add_partners(batch: pa.RecordBatch, item_set: pa.Array, word_set: pa.Array, both: np.ndarray, far: np.ndarray) -> None:
    """Count, per item and word, the texts that have the word in another clause than the item, and more than one clause away.

    For that it is enough to know a word's first and last clause in a text.
    """
    texts, clauses = batch.num_rows, batch.column(0)
    per_text = np.diff(clauses.offsets.to_numpy())
    inner = clauses.flatten()
    per_clause = np.diff(inner.offsets.to_numpy())
    text_of_clause = np.repeat(np.arange(texts), per_text)
    clause_no = np.arange(len(per_clause)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    word = pc.fill_null(pc.index_in(inner.flatten(), word_set), -1).to_numpy()
    t, c = np.repeat(text_of_clause, per_clause)[word >= 0], np.repeat(clause_no, per_clause)[word >= 0]
    word = word[word >= 0]
    none = 1 << 30
    first, last = np.full((texts, len(word_set)), none, np.int32), np.full((texts, len(word_set)), -none, np.int32)
    np.minimum.at(first, (t, word), c)
    np.maximum.at(last, (t, word), c)
    phrases = batch.column(1)
    told = phrases.flatten()
    item = pc.fill_null(pc.index_in(told.field("phrase"), item_set), -1).to_numpy()
    t = np.repeat(np.arange(texts), np.diff(phrases.offsets.to_numpy()))[item >= 0]
    c = told.field("clause").to_numpy(zero_copy_only=False)[item >= 0]
    item = item[item >= 0]
    # an item counts where it is said first
    order = np.lexsort((c, t, item))
    item, t, c = item[order], t[order], c[order]
    kept = np.concatenate([[True], (item[1:] != item[:-1]) | (t[1:] != t[:-1])]) if len(item) else np.zeros(0, bool)
    item, t, c = item[kept], t[kept], c[kept]
    for part in np.split(np.arange(len(item)), np.flatnonzero(item[1:] != item[:-1]) + 1) if len(item) else ():
        i, here = item[part[0]], c[part][:, None]
        a, b = first[t[part]], last[t[part]]
        both[i] += ((a != here) & (a < none) | (b != here) & (b > -none)).sum(axis=0)
        far[i] += ((a < here - 1) | (b > here + 1)).sum(axis=0)


def _cells(texts: DataFrame, frame: list[str], same: DataFrame | None, n: int) -> DataFrame:
    """(message_id, cell, members, density) for the dense cells of every text."""
    phrased = texts.select("message_id", _phrases(F.col("clauses"), frame).alias("p"))
    spots = phrased.select("message_id", F.explode("p").alias("p")).groupBy("message_id", F.col("p.phrase").alias("phrase")).agg(
        F.min("p.clause").alias("clause")
    )
    spots = materialize(spots, "phrases")
    if same is not None:
        spots = materialize(_renamed(spots, same), "phrases")
    counts = materialize(spots.groupBy("phrase").count().filter("count > 1"), "phrase-counts")
    # fewer than phrases-per-text / TESTED_SHARE of them
    tested = {r.phrase: r[1] for r in counts.filter(F.col("count") > TESTED_SHARE * n).toLocalIterator()}
    often_said = texts.sparkSession.createDataFrame([(w,) for w in tested], "phrase string")
    said = spots.join(F.broadcast(often_said), "phrase").groupBy("message_id").agg(F.collect_list(F.struct("phrase", "clause")).alias("p"))
    bound = _bound(texts.join(said, "message_id").select("clauses", "p"), tested, _often(texts, TESTED_SHARE * n / 2), n)
    idle = texts.sparkSession.createDataFrame([(w,) for w in tested if w not in bound], "phrase string")
    axes = counts.join(F.broadcast(idle), "phrase", "left_anti")
    marked = axes.select("phrase", F.xxhash64("phrase").alias("mark"), (F.col("count") / n).alias("share"), F.col("count").alias("load"))
    points = lookup(spots, marked, "phrase").groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("clause", "mark", "share", "phrase"))).alias("f"))
    points = materialize(points, "points")
    # every choice of three phrases from different clauses, of SPAN in a row, is the text's cell in that subspace; a phrase and those
    # of the clauses after it are a row of their own, so that a long text's cells are never together
    ahead = F.transform("f", lambda a, i: F.struct(a["mark"].alias("mark"), a["share"].alias("share"), F.transform(
        F.filter(F.slice("f", i + 2, F.lit(SPAN * CLAUSE_WORDS)), lambda b: (b["clause"] > a["clause"]) & (b["clause"] < a["clause"] + SPAN)),
        lambda b: F.struct(b["clause"].alias("clause"), b["mark"].alias("mark"), b["share"].alias("share")),
    ).alias("after")))
    opened = points.select("message_id", F.explode(ahead).alias("a")).select("message_id", "a.*").filter("size(after) > 1")
    # sums of the products of one, two and three shares, from which the share of strangers in a cell is taken below
    pairs = F.flatten(F.transform("after", lambda b, j: F.transform(
        F.filter(F.slice("after", j + 2, F.size("after")), lambda c: c["clause"] > b["clause"]),
        lambda c: F.struct(c["clause"].alias("clause"), b["mark"].bitwiseXOR(c["mark"]).alias("mark"), (b["share"] + c["share"]).alias("s1"), (b["share"] * c["share"]).alias("s2"), F.greatest(b["share"], c["share"]).alias("most")),
    )))
    paired = opened.select("message_id", "mark", "share", "after", F.explode(pairs).alias("p"))
    a, p, none = F.col("share"), F.col("p"), F.lit(0.0).cast("float")
    short = lambda c: c.cast("float")
    three = paired.select(
        "message_id", F.col("mark").bitwiseXOR(p["mark"]).alias("cell"), F.round(a * p["s2"] * n, 12).alias("chance"),
        short(a + p["s1"]).alias("e1"), short(a * p["s1"] + p["s2"]).alias("e2"), none.alias("e3"),
    )
    common = F.filter("after", lambda d: (d["clause"] > p["clause"]) & (a * p["s2"] * d["share"] * n > STRANGERS[0] * F.greatest(a, p["most"], d["share"])))
    four = paired.select("message_id", "mark", "share", "p", F.explode(common).alias("d"))
    d = F.col("d.share")
    four = four.select(
        "message_id", F.xxhash64(F.lit("four"), F.col("mark").bitwiseXOR(p["mark"]).bitwiseXOR(F.col("d.mark"))).alias("cell"), (a * p["s2"] * d * n).alias("chance"),
        short(a + p["s1"] + d).alias("e1"), short(a * p["s1"] + p["s2"] + d * (a + p["s1"])).alias("e2"), short(a * p["s2"] + d * (a * p["s1"] + p["s2"])).alias("e3"),
    )
    unchecked = _short_cells(texts, points, n).select("message_id", "cell", "chance", none.alias("e1"), none.alias("e2"), none.alias("e3"))
    filled = materialize(three.unionByName(four).unionByName(unchecked), "cells")
    q = F.col("members") / n
    others = n * F.when(F.col("e3") > 0, F.col("chance") / n - q * F.col("e3") + q * q * F.col("e2") - q * q * q * F.col("e1") + q * q * q * q).when(
        F.col("e1") > 0, F.col("chance") / n - q * F.col("e2") + q * q * F.col("e1") - q * q * q).otherwise(0.0)
    excess = F.col("members") * F.log(F.col("members") / F.col("chance")) - F.col("members") + F.col("chance")
    dense = filled.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), *[F.min(c).alias(c) for c in ("chance", "e1", "e2", "e3")]).filter("members > 1").filter(others <= F.greatest(F.lit(STRANGERS[0]), STRANGERS[1] * F.col("members"))).withColumn(
        "density", excess
    ).filter(F.col("density") >= DENSITY + math.log(USUAL))
    return lookup(filled.select("message_id", "cell"), materialize(dense.select("cell", "members", "density", F.col("members").alias("load")), "dense-cells"), "cell")


def _short_cells(texts: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """(message_id, cell, chance) of texts with fewer than DIMENSIONS clauses that have words.

    Their cells are all the phrases they have, and those left when one word is taken out, so short
    texts meet that differ in a word. One phrase alone is no cell.
    """
    short = texts.filter(F.size(F.filter("clauses", lambda c: F.size(c) > 0)) < DIMENSIONS).select("message_id")
    words = F.array_distinct(F.flatten(F.transform("f", lambda a: F.split(a["phrase"], " "))))
    without = F.transform(words, lambda w: F.filter("f", lambda a: ~F.array_contains(F.split(a["phrase"], " "), w)))
    kept = F.array_distinct(F.transform(F.concat(F.array("f"), without), lambda f: F.transform(f, lambda a: F.struct(a["phrase"].alias("phrase"), a["share"].alias("share")))))
    sets = points.join(short, "message_id", "left_semi").select("message_id", F.explode(kept).alias("k")).filter("size(k) > 1")
    chance = F.aggregate("k", F.lit(float(n)), lambda x, a: x * a["share"])
    return sets.select("message_id", F.xxhash64(F.lit("short"), F.sort_array(F.transform("k", lambda a: a["phrase"]))).alias("cell"), chance.alias("chance"))


def _equal_cells(texts: DataFrame, n: int) -> DataFrame:
    """(message_id, cell, members, density) of texts whose whole normalised text is that of others."""
    m = F.col("members")
    equal = texts.groupBy(F.col("whole").alias("cell")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(
        "cell", "members", (m * F.log(n / m) - m + m * m / n).alias("density"), m.alias("load")
    )
    return lookup(texts.select("message_id", F.col("whole").alias("cell")), materialize(equal, "equal-texts"), "cell")


def _group(cells: DataFrame) -> DataFrame:
    """(message_id, label) by joining dense cells that share a text."""
    least = cells.groupBy("message_id").agg(F.min("cell").alias("least"))
    links = cells.select("message_id", "cell").join(least, "message_id").select(F.col("cell").alias("a"), F.col("least").alias("b")).distinct()
    labels = components(links).withColumnRenamed("node", "least")
    load = least.groupBy("least").agg(F.count(F.lit(1)).alias("load"))
    return lookup(least, materialize(labels.join(load, "least"), "least-labels"), "least").select("message_id", "label")


def _alternates(texts: DataFrame, groups: DataFrame, frame: list[str]) -> DataFrame:
    """(word, label) of words that stand for each other, label being the least of them: the same neighbour, in the same cluster, in ALTERNATES clusters or more.

    A word also has to be exchanged for the other in a good part of the clusters that have it, so
    two words of different meaning that one cluster mixes aren't joined.
    """
    phrased = texts.select("message_id", F.explode(_phrases(F.col("clauses"), frame)).alias("p")).select("message_id", F.split("p.phrase", " ").alias("w")).filter("size(w) = 2")
    held = phrased.join(groups, "message_id").groupBy("label", "w").agg(F.count(F.lit(1)).alias("k"))
    held = materialize(held, "held")
    sides = held.select("label", F.lit("l").alias("side"), F.col("w")[0].alias("kept"), F.col("w")[1].alias("word"), "k").unionByName(
        held.select("label", F.lit("r").alias("side"), F.col("w")[1].alias("kept"), F.col("w")[0].alias("word"), "k")
    )
    used = sides.select("label", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("clusters"))
    # a word of fewer clusters stands for none in as many
    sides = materialize(sides.join(used.filter(F.col("clusters") >= ALTERNATES).select("word"), "word", "left_semi"), "sides")
    one = sides.select("label", "side", "kept", F.col("word").alias("x"))
    two = sides.select("label", "side", "kept", F.col("word").alias("y"))
    pairs = (
        one.join(two, ["label", "side", "kept"]).filter("x < y").select("x", "y", "label").distinct()
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ALTERNATES)
    )
    strong = (
        pairs.join(used.withColumnsRenamed({"word": "x", "clusters": "cx"}), "x").join(used.withColumnsRenamed({"word": "y", "clusters": "cy"}), "y")
        .filter(F.col("n") >= 0.3 * F.least("cx", "cy"))
    )
    labels = components(strong.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return labels.filter("node <> label").withColumnRenamed("node", "word")


def cluster_texts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and cells of (message_id, text): (message_id, first_id, density) and the dense cells.

    Texts are quantised into phrases (neighbouring content words of a clause); three phrases of
    different clauses, of SPAN in a row, are a cell, so the cells of a long text grow as its length. A cell is dense if it holds more texts than chance would put there;
    cells that share a text are adjacent, and adjacent dense cells form a cluster. Three phrases that texts of other needs may be expected
    to share (STRANGERS) are no cell; with a fourth they are. A first
    grouping shows which words stand for each other; the grid is then laid again with those joined.
    first_id is the least id of the cluster. Texts in no dense cell are in no cluster. Equal texts of
    different ids are members of their own and always share a cell, however short they are; texts of
    fewer than three clauses have cells of all their phrases (see `_short_cells`). Everything is counted over all texts; what goes to
    the driver is the common words and phrases only.
    """
    spark = messages.sparkSession
    with scratch_scope(spark) as scope:
        members, cells = _clustered(messages)
        return scope.keep(materialize(members, "members")), scope.keep(materialize(cells, "cells-of-members"))


def _clustered(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = F.array_join(F.flatten("clauses"), " ")
    bare = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))  # of texts without words
    texts = messages.select(F.col("message_id").alias("name"), "text", _clauses(F.col("text")).alias("clauses"))
    # texts go by a number, stored once, until the end
    texts = materialize(texts.select("name", F.monotonically_increasing_id().alias("message_id"), "clauses", F.xxhash64(F.lit("whole"), F.when(said != "", said).otherwise(bare)).alias("whole")), "texts")
    names, texts = texts.select("message_id", "name"), texts.drop("name")
    n = max(1, texts.count())
    frame = _common_words(texts, n)
    equal = materialize(_equal_cells(texts, n), "equal")
    cells = materialize(_cells(texts, frame, None, n).unionByName(equal), "dense")
    same = _alternates(texts, materialize(_group(cells), "groups"), frame)
    if not same.isEmpty():
        cells = materialize(_cells(texts, frame, same, n).unionByName(equal), "dense")
    groups = materialize(_group(cells).join(names, "message_id"), "groups")
    first = groups.groupBy("label").agg(F.min("name").alias("first_id"), F.count(F.lit(1)).alias("cluster_size"))
    density = cells.groupBy("message_id").agg(F.max("members").alias("densest"), F.sum("density").alias("density"))
    first = materialize(first.withColumn("load", F.col("cluster_size")), "first")
    members = lookup(groups, first, "label").join(density, "message_id").select(F.col("name").alias("message_id"), "first_id", "cluster_size", "densest", "density")
    return members, cells.join(names, "message_id").select(F.col("name").alias("message_id"), "cell", "members", "density")


def describe(members: DataFrame, messages: DataFrame, k: int = 10, salts: int = 64) -> DataFrame:
    """(first_id, cluster_size, representative_texts): the k members of the densest cells, ties by id.

    The best k are taken per salted part of a cluster and then of those, so no task sorts a whole
    large cluster.
    """
    order = [F.desc("densest"), F.desc("density"), F.col("message_id")]
    part = Window.partitionBy("first_id", "salt").orderBy(*order)
    whole = Window.partitionBy("first_id").orderBy(*order)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("message_id"), F.lit(salts)))
    few = salted.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k)
    return few.join(messages.select("message_id", "text"), "message_id").groupBy("first_id").agg(
        F.max("cluster_size").alias("cluster_size"), F.sort_array(F.collect_list(F.struct("r", "text"))).alias("s")
    ).select("first_id", "cluster_size", F.transform("s", lambda x: x["text"]).alias("representative_texts"))
