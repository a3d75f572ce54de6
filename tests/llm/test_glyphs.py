import unicodedata

from loomspark.llm import glyphs as G

GROUPS = [
    ["a fine-tuned café here", "а fine‐tuned café here", "a ﬁne‑tuned café here", "ａ​ ｆine-tuned café here", "a fine-tuned café he­re"],
    ["Привет мир", "Пpивeт миp"],
    ["й ok", "й ok"],
]
ALONE = ["a fine-tuned cafe here", "A fine-tuned café here", "a fine–tuned café here", "a fine-tuned café  here", "a fine-tuned café here.", "a fine-tuned café here 2", "a fine-tuned café here ²", "\U0001f469‍\U0001f527", "\U0001f469\U0001f527", "l", "I", "1", "O", "0"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, form string, class_id string")


def test_pairs(spark):
    texts = [t for g in GROUPS for t in g] + ALONE + [None, "", " ", "​", " "] + [GROUPS[0][0]]
    got = {(r.doc_a, r.doc_b) for r in G.lookalike_pairs(frame(spark, texts)).collect()}
    want = set()
    for g in GROUPS:
        ids = [i for i, t in enumerate(texts) if t in g]
        want |= {(a, b) for a in ids for b in ids if a < b and texts[a] != texts[b]}
    assert got == want


def test_composed_and_decomposed_letters_of_other_scripts(spark):
    whole = ["Ёжик ещё её несёт", "ѐ ў ї Ќ ѓ", "ά ό Έ ὰ ᾂ", "ё", "е"]
    apart = [unicodedata.normalize("NFD", t) for t in whole]
    latin = [whole[0].replace("е", "e"), whole[3].replace("ё", "ë"), apart[3].replace("е", "e")]
    got = {(r.doc_a, r.doc_b) for r in G.lookalike_pairs(frame(spark, whole + apart + latin)).collect()}
    n = len(whole)
    assert {(i, i + n) for i in range(n) if whole[i] != apart[i]} <= got
    assert {p for p in got if 0 in p or n in p} == {(0, n), (0, 2 * n), (n, 2 * n)}
    assert {p for p in got if 3 in p} == {(3, n + 3), (3, 2 * n + 1), (3, 2 * n + 2)} and not any(4 in p for p in got)


def test_consistent_texts(spark):
    texts = [*GROUPS[0], *GROUPS[1], None, "", "alone here", "x" * 200_000]
    rows = {r.doc_id: (r.class_id, r.text) for r in G.consistent_texts(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    assert {rows[i][1] for i in range(5)} == {"a fine-tuned café here"}
    assert {rows[i][1] for i in (5, 6)} == {"Привет мир"}
    assert rows[7] == (None, None) and rows[8] == (None, "") and rows[9][1] == "alone here" and rows[10][1] == "x" * 200_000


def test_many_copies_are_not_paired_with_each_other(spark):
    texts = ["same text"] * 400 + ["same text"] * 2
    assert G.lookalike_pairs(frame(spark, texts)).count() == 800


def test_empty(spark):
    assert G.lookalike_pairs(frame(spark, [])).count() == 0
    assert G.consistent_texts(frame(spark, [])).count() == 0


def test_tables_pair_up():
    assert len(G.LOOKALIKE_FROM) == len(G.LOOKALIKE_TO) == len(set(G.LOOKALIKE_FROM))
    assert len(G.WIDE_FROM) == len(G.WIDE_TO)
