"""Held-out items that occur, wholly or in part, in a training corpus."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.glyphs import skeleton
from loomspark.runtime import materialize, scratch_path

WORD = re.compile(r"[^\W_]+")
# Spaced seeds over RUN tokens: a 0 is a token that is ignored. Each spans RUN at most, and together they hit every run of
# RUN tokens in which no more than two are changed, whichever these are.
RUN = 8
MASKS = ("11101", "100111", "11010011")
BLOCK_WORDS = 1_000_000  # words of items that are sent to the tasks at once
WORDS_AT_ONCE = 20_000  # words of documents that are searched together
# Small letters whose capitals look like Latin ones, so that case doesn't matter after the look-alike map.
FOLD = dict(zip("нвкмт" "βεζηκμτχ", "hbkmt" "bezhkmtx"))
SCRIPTS = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
# ASCII letters in lower case and digits as they are, anything else a blank
ASCII_WORDS = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def _folded() -> dict[int, str]:
    """FOLD, and the letters that are composed of one of its letters and accents."""
    table = {ord(a): b for a, b in FOLD.items()}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and base in FOLD:
            table[c] = unicodedata.normalize("NFC", FOLD[base] + "".join(marks))
    return table


FOLDED = _folded()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of a text in look-alike form, in one case, with accents in composed form."""
    if not text:
        return []
    if text.isascii():
        return text.translate(ASCII_WORDS).split()
    text = unicodedata.normalize("NFC", text.lower())
    return WORD.findall(text.translate(FOLDED) if SCRIPTS.search(text) else text)


class SeedIndex:
    """Seeds of a bounded block of items, sorted by hash, with the items' words for the check."""

    def __init__(self, items: list[tuple[int, str]], near_share: float = 0.5):
        self.near_share = near_share
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            tokens = words(text)
            if len(tokens) >= RUN:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens], dtype=np.int64))
        self.seeds = []
        lengths = [len(t) for t in self.items]
        flat = self.flat = np.concatenate(self.items) if self.items else np.empty(0, np.int64)
        self.ends = np.cumsum(lengths, dtype=np.int64)
        item, place = np.repeat(np.arange(len(lengths)), lengths), _within(lengths)
        for mask in MASKS:
            at = _inside(lengths, len(mask))
            h = seed_hashes(flat, mask, at)
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], item[at][order], place[at][order]))

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the document, item position, words, words in exact runs, words in runs with changes)."""
        lo = 0
        while lo < len(docs):  # many documents at once, but few enough words for a processor's cache
            hi, total = lo, 0
            while hi < len(docs) and (hi == lo or total + len(docs[hi]) <= WORDS_AT_ONCE):
                total += len(docs[hi])
                hi += 1
            for d, *found in self._search(docs[lo:hi], total):
                yield (lo + d, *found)
            lo = hi

    def _search(self, docs: list[list[str]], total: int) -> Iterator[tuple[int, int, int, int, int]]:
        if not total or not self.items:
            return
        get = self.vocabulary.get
        flat = np.array([get(t, -1) for d in docs for t in d], dtype=np.int64)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        doc_of, place_of = np.repeat(np.arange(len(docs)), lengths), _within(lengths)
        left = np.repeat(lengths, lengths) - place_of
        known = flat >= 0
        found = []
        for mask, (hashes, item, place) in zip(MASKS, self.seeds):
            ok = left >= len(mask)
            for j, bit in enumerate(mask):
                if bit == "1":
                    ok[: total - j] &= known[j:]
            at = np.flatnonzero(ok)
            h = seed_hashes(flat, mask, at)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            times = hi - lo
            at = np.repeat(at, times)
            hit = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(len(at))
            near = self._near(flat, lengths[doc_of[at]], at, place_of[at], item[hit], place[hit])
            at, hit = at[near], hit[near]
            found.append((doc_of[at] * len(self.items) + item[hit], place_of[at] - place[hit], place[hit]))
        pair, shift, q = (np.concatenate(c) for c in zip(*found))
        if len(pair):
            yield from self._verify(flat, starts, lengths, pair, shift, q)

    def _near(self, flat: np.ndarray, length: np.ndarray, at: np.ndarray, place: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Hits with a run around them in which no more than two of RUN words differ; most chance hits have none."""
        size = np.diff(self.ends, prepend=0)[item]
        first = self.ends[item] - size
        run, best = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8)
        lately: list[np.ndarray] = []
        for o in range(1 - RUN, 2 * RUN - 1):
            within = (place + o >= 0) & (place + o < length) & (q + o >= 0) & (q + o < size)
            same = within & (flat[np.where(within, at + o, 0)] == self.flat[np.where(within, first + q + o, 0)])
            lately.append(same)
            run = run + same - (lately[-1 - RUN] if len(lately) > RUN else 0)
            best = np.maximum(best, run)
        return best >= RUN - 2

    def _verify(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pair: np.ndarray, shift: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Words in runs, per document and item, from hits (pair of both, shift, place in the item), over all diagonals at once.

        Every run has a hit within it, so nothing but the words around a diagonal's hits is looked at. These stretches form
        one long array, in which runs are counted by cumulative sums.
        """
        order = np.lexsort((q, shift, pair))
        pair, shift, q = pair[order], shift[order], q[order]
        # a stretch ends where the next hit is too far off for a run to reach both
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1]) | (q[1:] - q[:-1] > 2 * RUN)])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(q) - 1]])
        pair, shift, low, high = pair[new], shift[new], q[new], q[last]
        doc, item = np.divmod(pair, len(self.items))
        size = np.diff(self.ends, prepend=0)[item]
        low = np.maximum(np.maximum(low - RUN + 1, 0), -shift)
        high = np.minimum(np.minimum(high + 2 * RUN - 1, size), lengths[doc] - shift)
        width = high - low
        line, at = np.repeat(np.arange(len(pair)), width), _within(width) + np.repeat(low, width)
        same = flat[(starts[doc] + shift)[line] + at] == self.flat[(self.ends[item] - size)[line] + at]
        sums = np.concatenate([[0], np.cumsum(same)])
        begin = np.flatnonzero(at + RUN <= high[line])
        equal = sums[begin + RUN] - sums[begin]
        longest = int(size.max())
        pairs, group = np.unique(pair, return_inverse=True)
        counts = []
        for least in (RUN, RUN - 2):
            held = np.flatnonzero(covered(same, begin[equal >= least]))
            once = np.unique(group[line[held]] * longest + at[held])  # diagonals may cover the same word
            counts.append(np.bincount(once // longest, minlength=len(pairs)))
        exact, near = counts
        doc, item = np.divmod(pairs, len(self.items))
        size = np.diff(self.ends, prepend=0)[item]
        for g in np.flatnonzero((exact > 0) | (near >= self.near_share * size)).tolist():
            yield int(doc[g]), int(item[g]), int(size[g]), int(exact[g]), int(near[g])


def _within(lengths: list[int]) -> np.ndarray:
    """0, 1, ... within each of the sequences of these lengths."""
    sizes = np.asarray(lengths, dtype=np.int64)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _inside(lengths: list[int], span: int) -> np.ndarray:
    """Places, in the joined sequences, from which `span` tokens are of one sequence."""
    return np.flatnonzero(_within(lengths) + span <= np.repeat(np.asarray(lengths, dtype=np.int64), lengths))


def seed_hashes(tokens: np.ndarray, mask: str, at: np.ndarray) -> np.ndarray:
    """A hash for each place of `at`, of the tokens where the mask has a 1."""
    x = tokens.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    out = np.zeros(len(at), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0xBF58476D1CE4E5B9) + x[at + j]
    return out


def covered(same: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Equal positions that lie in one of the windows of RUN that start at these places."""
    edge = np.zeros(len(same) + RUN + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + RUN] -= 1
    return (np.cumsum(edge[: len(same)]) > 0) & same


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, exact_words, near_words) for every document and item that overlap.

    They overlap if they share an exact run, or if runs with changed words hold half of the item's words.
    exact_words counts the item's words that occur in the document in runs of RUN or more
    consecutive words, near_words those in runs with up to two changed words in RUN; no such run is missed. Both texts
    are compared in their look-alike form, in lower case, words only. Items of fewer than RUN words,
    null and empty texts give no rows; repeated item rows count once per id and text.

    Items are taken in blocks of about `block_words` words, whose indexes are stored in the shared folder. A task reads
    its documents once, holds them as words, and goes through the blocks one by one, so it never has more than one block; the
    corpus isn't shuffled.
    """
    shaped = items.select(F.col(item_id).alias("item_id"), skeleton(F.col("text")).alias("text"), F.length("text").alias("n")).filter("n > 0").distinct()
    blocks = materialize(shaped.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(_block_count(shaped, block_words)))), "items")
    corpus = docs.filter(F.col("text").isNotNull()).select(F.col(doc_id).alias("doc_id"), skeleton(F.col("text")).alias("text"))
    base, paths = scratch_path(docs.sparkSession, "seed-indexes"), []
    for (block,) in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        rows = [(r.item_id, r.text) for r in blocks.filter(F.col("block") == block).toLocalIterator()]
        paths.append(f"{base}/{block:06d}")
        store, inner = fs.FileSystem.from_uri(paths[-1])
        store.create_dir(inner.rpartition("/")[0])
        with store.open_output_stream(inner, compression=None) as out:
            pickle.dump(SeedIndex(rows), out, pickle.HIGHEST_PROTOCOL)
    return corpus.mapInArrow(_search(paths), "doc_id long, item_id long, item_words int, exact_words int, near_words int")


def _block_count(shaped: DataFrame, block_words: int) -> int:
    chars = shaped.agg(F.sum("n")).first()[0] or 0
    return max(1, -(-chars // (4 * block_words)))


def _search(paths: list[str]):
    def load(path: str) -> SeedIndex:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner, compression=None) as file:
            return pickle.load(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = "", None
        for batch in batches:
            ids, docs = batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()]
            for path in paths:
                if path != held:
                    index = None  # before the next is read
                    held, index = path, load(path)
                found = list(index.search(docs))
                if found:
                    out = [(ids[d], index.ids[k], n, exact, near) for d, k, n, exact, near in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                        ["doc_id", "item_id", "item_words", "exact_words", "near_words"],
                    )

    return run
