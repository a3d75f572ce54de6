"""Token ids of whole corpora with a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = os.environ.get("LOOMSPARK_RANK_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Between a letter or digit, of any script, and the white space after it a token always ends, whatever follows.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")
PIECE = 1 << 16


@lru_cache(maxsize=4)
def encoder(rank_file: str, split: str = SPLIT):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(rank_file), pat_str=split, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """A text in pieces of about `size` characters whose encodings join to that of the whole text.

    A text without a safe boundary stays in one piece.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode(text: str, rank_file: str = RANK_FILE) -> list[int]:
    coder = encoder(rank_file)
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text) for i in coder.encode_ordinary(piece)]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """(id, ids): one row per input row; null and empty texts have an empty list.

    Names of special tokens are ordinary text. `rank_file` must be readable on every executor.
    Narrow: no shuffle, and a task holds one Arrow batch. Other columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, chunks, at = [0], [], 0
            for text in batch.column(1).to_pylist():
                ids = np.asarray(encode(text, rank_file) if text else [], dtype=np.int32)
                at += len(ids)
                chunks.append(ids)
                offsets.append(at)
            flat = np.concatenate(chunks) if chunks else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_column(encoded: DataFrame, id_col: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """(id, text) from (id, ids): bytes of all tokens are joined before they are read as UTF-8.

    Ids that don't form valid UTF-8 give replacement characters; a null list gives a null text.
    """
    id_type = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_file)
        for batch in batches:
            texts = [None if ids is None else coder.decode_bytes(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, text string")
