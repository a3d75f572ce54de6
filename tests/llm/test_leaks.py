import itertools
import random
import unicodedata

import numpy as np

from loomspark.llm import leaks


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = leaks.words(text)
        grams = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, it in items:
            v = leaks.words(it)
            cov = set()
            for i in range(len(v) - 7):
                if tuple(v[i : i + 8]) in grams:
                    cov |= set(range(i, i + 8))
            if cov:
                out[d, k] = (len(v), len(cov))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, "Read this and answer. " + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(4, 50)))) for k in range(25)]
    docs = []
    for d in range(120):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.5:
            part = leaks.words(rnd.choice(items)[1])
            a = rnd.randrange(len(part))
            part = part[a : a + rnd.randrange(5, 40)]
            if part and rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = "changed"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, " ".join(text)))
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
    k = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    return leaks.leaks(d, k, **kw)


def test_same_as_brute_force(spark):
    docs, items = corpus()
    docs += docs[:3] + [(900, None), (901, "")]
    rows = run(spark, docs, items + items[:2]).collect()
    assert {(r.doc_id, r.item_id): (r.item_words, r.exact_words) for r in rows if r.exact_words} == brute(docs, items)
    in_blocks = run(spark, docs, items, block_words=60).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks if r.exact_words} == set(brute(docs, items))


def test_form_does_not_matter_and_changes_are_seen(spark):
    item = "The quick brown fox jumps over the lazy dog near our café"
    docs = [(1, "> “THE  quick-brown fоx ｊｕｍｐｓ over, the\nlazy dog; near our café!"), (2, item.replace("jumps", "leaps")), (3, item.replace("café", "cafe")), (4, "x" * 400_000 + " " + item)]
    got = {r.doc_id: (r.exact_words, r.near_words) for r in run(spark, docs, [(7, item), (8, "short one"), (9, None), (10, "")]).collect()}
    assert got[1] == (12, 12) and got[4] == (12, 12) and got[3][0] == 11
    assert got[2][0] == 0 and got[2][1] >= 8


def test_empty(spark):
    assert run(spark, [], [(1, "a b c d e f g h")]).count() == 0
    assert run(spark, [(1, "a b c d e f g h")], []).count() == 0


def test_masks_hit_every_run_with_two_changes():
    assert all(len(m) <= leaks.RUN and m[0] == "1" and "0" in m for m in leaks.MASKS)
    for gone in itertools.combinations(range(leaks.RUN), 2):
        assert any(all(b == "0" or j + s not in gone for j, b in enumerate(m)) for m in leaks.MASKS for s in range(leaks.RUN - len(m) + 1)), gone


def near_brute(docs, items):
    out = {}
    for d, text in docs:
        w = leaks.words(text)
        for k, it in items:
            v, cov = leaks.words(it), set()
            for i in range(len(v) - 7):
                for j in range(len(w) - 7):
                    same = [x for x in range(8) if v[i + x] == w[j + x]]
                    if len(same) >= 6:
                        cov |= {i + x for x in same}
            if cov and 2 * len(cov) >= len(v):
                out[d, k] = len(cov)
    return out


def test_changed_words_are_found_as_by_brute_force(spark):
    """Copies with every second to ninth word changed; every fourth makes two changes in eight."""
    vocab = [f"w{i}" for i in range(400)]
    rnd = random.Random(5)
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(60))) for k in range(6)]
    docs = []
    for k, text in items:
        for step in range(2, 10):
            w = text.split()
            w[:: step] = ["other"] * len(w[:: step])
            docs.append((len(docs), "before that " + " ".join(w)))
    want = near_brute(docs, items)
    got = {(r.doc_id, r.item_id): r.near_words for r in run(spark, docs, items).collect() if 2 * r.near_words >= r.item_words}
    assert got == want and len(want) == 6 * 7


def test_case_of_other_scripts(spark):
    item = "Новый товар пришёл к нам вчера вечером и стоит недорого"
    docs = [(1, item.upper()), (2, item.lower()), (3, unicodedata.normalize("NFD", item.upper())), (4, item.replace("о", "o").replace("Н", "H"))]
    got = {r.doc_id: r.exact_words for r in run(spark, docs, [(7, item)]).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 10}


def test_covered():
    same = np.array([1, 1, 1, 1, 1, 1, 1, 1, 0, 1], dtype=bool)
    assert leaks.covered(same, np.array([0, 2])).tolist() == [True] * 8 + [False, True]
    assert not leaks.covered(same, np.array([], dtype=int)).any()
