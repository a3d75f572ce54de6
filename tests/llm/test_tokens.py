import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANK_FILE), reason="no rank file")


def test_documents_with_null_empty_blank_and_special_names(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "a <|endoftext|> b", "x"), (5, "héllo 🐝", None)]
    got = {r.doc_id: r.ids for r in tokens.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [220]
    assert 50256 not in got[4]
    back = tokens.decode_column(tokens.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string")))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "", 2: "", 3: " ", 4: rows[3][1], 5: rows[4][1]}
    assert tokens.encode_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_ids_as_the_other_library():
    hf = pytest.importorskip("tokenizers")
    path = tokens.RANK_FILE.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no json vocabulary")
    t = hf.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in ("It's  been\n\n\ta while…  ", "naïve café ﬁ １２３ <|endoftext|>", "a" * 5000, " \n x'll'd 've"):
        assert tokens.encode(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \n\t'sé. ", max_size=60), st.integers(1, 9))
def test_pieces_join_to_the_whole(text, size):
    coder = tokens.encoder(tokens.RANK_FILE)
    parts = tokens.pieces(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_long_text():
    text = "word and 12 more\n" * 40_000
    assert len(tokens.pieces(text)) > 5
    assert tokens.encode(text) == tokens.encoder(tokens.RANK_FILE).encode_ordinary(text)


def test_long_texts_of_any_script_are_cut():
    for word in ("слово", "λέξη", "字词", "x²", "٣٤"):
        text = (word + " и\n ещё, ") * 20_000
        parts = tokens.pieces(text)
        assert len(parts) >= len(text) // (tokens.PIECE + 100) and "".join(parts) == text
        assert [i for p in parts for i in tokens.encoder(tokens.RANK_FILE).encode_ordinary(p)] == tokens.encoder(tokens.RANK_FILE).encode_ordinary(text)
