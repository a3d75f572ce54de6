import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import grid

SLOTS = [[f"{a}{b}{end}" for a in ("ro", "mi", "ta", "ke", "lu", "fo", "ne") for b in ("ban", "dil", "gor", "pes", "vum")] for end in ("ish", "er")]


def corpus(n_needs=30, per=9, seed=1):
    rnd = random.Random(seed)
    rows, truth = [], {}
    for need in range(n_needs):
        parts = [f"{rnd.choice(SLOTS[0])} {rnd.choice(SLOTS[1])}" for _ in range(4)] + [f"brand{need:03d} gadget"]
        frames = [["the {}", "in my {}"], ["so we get {}", "that means {}"], ["please make a {}", "i want a {}"], ["again the {}", "often the {}"], ["about our {}", "with the old {}"]]
        for _ in range(per):
            said = [rnd.choice(f).format(p) for f, p in zip(frames, parts)]
            rnd.shuffle(said)
            i = f"m{len(rows):05d}"
            rows.append((i, rnd.choice(["Quick question for you. ", "Long time reader, first post. ", ""]) + rnd.choice([", ", "; ", ". "]).join(said) + rnd.choice([" Thanks in advance.", "!", ""])))
            truth[i] = need
    return rows, truth


SHORT = {
    "hot": ["Where is my parcel?"] * 120, "odd": ["\U0001f44d \U0001f44d"] * 6,
    "near": [f"{w} purple zebra unicycle rental downtown" for w in ("nice", "Cheap", "best", "any", "good", "first")] + ["purple zebra scooter rental downtown"],
}


@pytest.fixture(scope="module")
def grouped(spark):
    """Planted needs, one of which holds a third of all rows, short texts, and texts of 5,000 phrases, clustered together."""
    rows, truth = corpus(40, 9)
    big = [r for r in rows if truth[r[0]] == 0]
    rows += [(f"x{i:04d}", big[i % len(big)][1]) for i in range(240)]
    rows += [(f"{g}{i}", t) for g, ts in SHORT.items() for i, t in enumerate(ts)]
    rnd = random.Random(3)
    filler = lambda end: end.join(f"w{rnd.randrange(10**9)} x{rnd.randrange(10**9)}" for _ in range(2_500))
    need = next(t for i, t in rows if truth.get(i) == 4)
    rows += [("long1", filler(", ") + ". " + need + ". " + filler(", ")), ("long2", filler(" ") + ". " + need)]
    members, _ = grid.cluster_texts(spark.createDataFrame(rows, "message_id string, text string"))
    return truth, {r.message_id: (r.first_id, r.cluster_size) for r in members.collect()}


def test_planted_needs_are_found(grouped):
    truth, found = grouped
    got = {i: f for i, (f, _) in found.items() if i in truth}
    by = {}
    for i, f in got.items():
        by.setdefault(f, set()).add(truth[i])
    assert all(len(s) == 1 for s in by.values()) and len(by) == 40
    assert len(got) >= 0.97 * len(truth)
    assert all(f == min(i for i, (g, _) in found.items() if g == f) for f in by)


def test_one_need_holds_a_third(grouped):
    truth, found = grouped
    assert len({found[f"x{i:04d}"] for i in range(240)} | {found[i] for i, need in truth.items() if need == 0}) == 1


def test_short_texts(grouped):
    """Copies of one sentence; others differ in a word or have no words."""
    _, found = grouped
    for g, ts in SHORT.items():
        assert {found.get(f"{g}{i}") for i in range(len(ts))} == {(f"{g}0", len(ts))}, g


def test_long_texts(grouped):
    """With and without signs, they share a need with short ones."""
    truth, found = grouped
    assert found["long1"][0] == found["long2"][0] == found[next(i for i, k in truth.items() if k == 4)][0]


def test_all_words_that_stand_for_each_other_are_joined(spark):
    """More strong pairs than any model that was sent to the driver held: 51,000, each in three clusters."""
    pairs = spark.range(51_000).selectExpr("concat('kept', id) as k", "concat('ax', id) as x", "concat('by', id) as y")
    told = pairs.selectExpr("explode(array(0, 1, 2)) as g", "*").selectExpr("concat('g', g) as label", "k", "explode(array(x, y)) as w")
    texts = told.selectExpr("concat(label, k, w) as message_id", "array(array(k, w)) as clauses", "label")
    same = grid._alternates(texts.select("message_id", "clauses"), texts.select("message_id", "label"), [])
    assert same.count() == 51_000 and same.filter("substr(word, 3) <> substr(label, 3) or word not like 'by%' or label not like 'ax%'").isEmpty()


def test_cells_are_judged_alike_at_every_size(spark):
    """Two texts that share a phrase of five texts and two phrases of 1 %, among n and ten times n."""
    for n in (6_000, 60_000):
        texts = spark.range(n).selectExpr(
            "concat('m', id) as message_id",
            "array(if(id < 5, array('rare', 'thing'), array('own' || id)), if(id < 2 or id % 200 in (10, 11), array('first', 'usual'), array('some' || id)), "
            "if(id < 2 or id % 200 in (20, 21), array('second', 'usual'), array('more' || id))) as clauses",
        )
        assert {(r.message_id, r.members) for r in grid._cells(texts, [], None, n).collect()} == {("m0", 2), ("m1", 2)}


def test_renamed_phrases(spark):
    spots = spark.createDataFrame([("m", "red car", 2), ("m", "red auto", 1), ("m", "alone", 3), ("n", "auto", 0)], "message_id string, phrase string, clause int")
    same = spark.createDataFrame([("car", "auto"), ("red", "dark")], "word string, label string")
    got = {tuple(r) for r in grid._renamed(spots, same).select("message_id", "phrase", "clause").collect()}
    assert got == {("m", "dark auto", 1), ("m", "alone", 3), ("n", "auto", 0)}


def test_partners_as_by_counting(spark):
    rnd = random.Random(9)
    texts = [[[rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 4))] for _ in range(rnd.randrange(0, 6))] for _ in range(300)]
    df = spark.createDataFrame([(t, [(w, j) for j, c in enumerate(t) for w in c]) for t in texts], "clauses array<array<string>>, p array<struct<phrase: string, clause: int>>").repartition(3)
    items, often = {"a": 1, "b": 1, "zz": 1}, {"a": 1, "c": 1, "d": 1}
    want = {}
    for t in texts:
        for i in items:
            at = next((j for j, c in enumerate(t) if i in c), None)
            for w in often if at is not None else ():
                beside = [j for j, c in enumerate(t) if w in c and j != at]
                if beside:
                    b, f = want.get((i, w), (0, 0))
                    want[i, w] = (b + 1, f + any(abs(j - at) > 1 for j in beside))
    found = df.mapInArrow(grid._count_partners(items, often), "item string, w string, both long, far long").groupBy("item", "w").agg(F.sum("both").alias("b"), F.sum("far").alias("f"))
    assert {(r.item, r.w): (r.b, r.f) for r in found.collect()} == want


def test_empty_blank_and_single(spark):
    for rows in ([], [("a", "one text alone")]):
        members, _ = grid.cluster_texts(spark.createDataFrame(rows, "message_id string, text string"))
        assert members.count() == 0


def test_distinct_messages(spark):
    piles = spark.createDataFrame([(["b", None, "", " "], ["1", "2", "3", "4"], "x"), (["a", "c"], ["1", None], None), (None, None, "y"), (["long" * 50_000], ["5"], "z"), (["t"], ["6", "7"], "q")], "texts array<string>, message_ids array<string>, text string")
    got = {r.message_id: r.text[:8] for r in grid.distinct_messages(piles).collect()}
    assert got == {"1": "a", "5": "longlong", "6": "t"}


def test_describe_takes_the_densest(spark):
    members = spark.createDataFrame([(f"m{i}", "m0", 30, i % 7, float(i)) for i in range(30)], "message_id string, first_id string, cluster_size long, densest long, density double")
    texts = members.selectExpr("message_id", "concat('text ', message_id) as text")
    row = grid.describe(members, texts, 3).collect()[0]
    assert (row.cluster_size, row.representative_texts) == (30, ["text m27", "text m20", "text m13"])


def test_three_common_phrases_join_no_strangers(spark):
    """Nine texts of four phrases that a hundredth of all texts have, each; a tenth text has three of these and another fourth."""
    drawn = ", ".join(f"array(if(id < {10 - (s == 'd')}, '{s}0', '{s}' || pmod(xxhash64(id, '{s}'), 100)), '{s}s')" for s in "abcd")
    texts = spark.range(40_000).selectExpr("concat('m', id) as message_id", f"array({drawn}) as clauses")
    cells = grid._cells(texts, [], None, 40_000)
    mates = cells.join(cells.filter("message_id = 'm0'").select("cell"), "cell").select("message_id").distinct()
    assert {r.message_id for r in mates.collect()} == {f"m{i}" for i in range(9)}
