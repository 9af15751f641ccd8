"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Method. A text's set is its distinct five-word shingles (lower-case words, split at ASCII
white space; a text of fewer words has one shingle, its whole word sequence; a text without words has
none). An item leaks into a document when at least ``threshold`` of the item's set is in the
document's set.

Plain MinHash can't see a short item in a long document, as their Jaccard similarity is tiny. So items
are partitioned by set size into geometric classes with upper bound u, and for each class a document
is read as overlapping windows of five quarters of u shingles, a quarter of u apart; a passage of u
shingles lies whole in some window. Within a class the containment threshold t becomes a Jaccard
bound of at least 0.8 t / (1.25 + 0.2 t) or so (0.45 for t = 0.8), and each of ``permutations`` MinHash
values is a band of its own. For a class a pair at the threshold is missed with a probability below
0.55 ** 24, about 6e-7, and a whole copy below 0.36 ** 24. An item whose shingles are strewn over a
document instead of lying in one window has a way of its own: the share of its MinHash shingles that
are in the document estimates the containment, and with a third of them the item is a candidate too (at the
threshold fewer than 8 of 24 has a probability of about 1e-7).
A window has an item's MinHash value only if it holds the very shingle that gives it, so one look at a
bitmap of those shingles tells most documents' windows apart from every item's without computing them;
windows are computed for the permutations and classes that can still collide.
Every candidate is verified on the strings of the shingles against the whole document.

The benchmark is a stated query set. It is read in blocks of at most ``block_chars`` characters, a
measured bound, and each block is one broadcast and one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 24
CLASS_RATIO = 1.25
BLOCK_CHARS = 2_000_000
_MEMO = 200_000

FOUND = "item_shingles long, shared_shingles long, containment double"

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = (_rng.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingle_strings(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Shingles in text order, repeats included."""
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


class _Hasher:
    """Shingle hashes of a word list, with a bounded memo of word hashes."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes], size: int = SHINGLE) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        memo, digest = self.memo, xxhash.xxh64_intdigest
        for w in set(words).difference(memo):
            memo[w] = digest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > _MEMO:
            memo.clear()
        n = max(1, len(words) - size + 1)
        out = np.full(n, np.uint64(min(len(words), size)))
        for k in range(min(size, len(words))):
            out = (out ^ h[k : k + n]) * _FOLD[k % len(_FOLD)]
            out ^= out >> np.uint64(29)
        return out


def _permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes * _MULTIPLY[k] + _ADD[k]
    return x ^ (x >> np.uint64(32))


def size_class(n: int) -> int:
    """The class of a set of n shingles; class c holds sizes up to CLASS_RATIO ** c."""
    return max(0, math.ceil(math.log(n) / math.log(CLASS_RATIO) - 1e-9))


class Index:
    """MinHash values of a bounded block of items, by size class and permutation."""

    def __init__(self, items: list[tuple[object, str, int]], permutations: int, size: int = SHINGLE):
        """items: id, text and number of equal rows."""
        self.size = size
        hasher = _Hasher()
        self.items: list[tuple[object, frozenset[bytes], int]] = []
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text, repeats in items:
            words = words_of(text)
            shingles = frozenset(shingle_strings(words, size))
            if not shingles:
                continue
            hashes = hasher(words, size)
            # the shingle that gives each MinHash value
            source = np.array([hashes[_permuted(hashes, k).argmin()] for k in range(permutations)], np.uint64)
            by_class.setdefault(size_class(len(shingles)), []).append((len(self.items), source))
            self.items.append((item_id, shingles, repeats))
        self.steps, self.tables = [], []
        target, use, owner_of = [], [], []
        for c, members in sorted(by_class.items()):
            at = len(self.steps)
            self.steps.append(max(1, math.ceil(CLASS_RATIO**c / 4)))
            own = []
            for k in range(permutations):
                source = np.array([s[k] for _, s in members], np.uint64)
                values = _permuted(source, k)
                order = np.argsort(values, kind="stable")
                own.append((values[order], np.array([i for i, _ in members], np.int64)[order]))
                target.append(source)
                use.append(np.full(len(members), at * permutations + k, np.int64))
                owner_of.append(np.array([i for i, _ in members], np.int64))
            self.tables.append(own)
        self.permutations = permutations
        self.target = np.concatenate(target) if target else np.zeros(0, np.uint64)
        order = np.argsort(self.target, kind="stable")
        self.target = self.target[order]
        self.use, self.owner = ((np.concatenate(x) if x else np.zeros(0, np.int64))[order] for x in (use, owner_of))
        bits = max(20, (16 * len(self.target)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.target >> self.shift] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the items that share a MinHash value with a window of the document."""
        near = np.unique(hashes[self.seen[hashes >> self.shift]])
        low, high = np.searchsorted(self.target, near), np.searchsorted(self.target, near, side="right")
        spans = [slice(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b]
        if not spans:
            return np.zeros(0, np.int64)
        strewn = np.bincount(np.concatenate([self.owner[s] for s in spans]))
        found = [np.flatnonzero(strewn >= self.permutations / 3)]
        # a document without the shingle behind a MinHash value has no window with that value
        for use in np.unique(np.concatenate([self.use[s] for s in spans])).tolist():
            at, k = divmod(use, self.permutations)
            values, owner = self.tables[at][k]
            # a window is five steps long and starts at a multiple of the step
            window = np.minimum.reduceat(_permuted(hashes, k), np.arange(0, len(hashes), self.steps[at]))
            short = window.copy()
            for shift in range(1, min(5, len(short))):
                np.minimum(window[:-shift], short[shift:], out=window[:-shift])
            place = np.searchsorted(values, window)
            place[place == len(values)] = 0
            for v in np.unique(window[values[place] == window]):
                found.append(owner[np.searchsorted(values, v) : np.searchsorted(values, v, side="right")])
        return np.unique(np.concatenate(found))


def _leaks(index, threshold: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hasher = index.value, _Hasher()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                near = held.candidates(hasher(words, held.size))
                if len(near):
                    own = set(shingle_strings(words, held.size))
                    for i in near.tolist():
                        item_id, shingles, repeats = held.items[i]
                        shared = len(shingles & own)
                        if shared >= threshold * len(shingles) - 1e-9:
                            rows += [(doc_id, item_id, len(shingles), shared, shared / len(shingles))] * repeats
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [batch.column(0).type, item_type, pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])

    return run


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str, int]]]:
    """The distinct items, with how often each occurs, in blocks of about block_chars characters, drawn to the driver one block at a time."""
    kept = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").groupBy("item_id", "text").count()
    total = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_chars))
    for p in range(parts):
        part = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else kept
        yield [(r.item_id, r.text, r["count"]) for r in part.toLocalIterator()]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document row, item row) with a containment of at least ``threshold``.

    Columns: doc_id, item_id (of their tables' types), item_shingles, shared_shingles (long), containment
    (double). Null and word-less texts, on either side, leak nothing; repeated rows of either table give
    repeated rows; a null id is returned as null. Texts of any length are read whole. Other columns are ignored, whatever their names. An empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own, item = texts.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema, item_type = f"doc_id {own.simpleString()}, item_id {item.simpleString()}, {FOUND}", to_arrow_type(item)
    found = [texts.mapInArrow(_leaks(spark.sparkContext.broadcast(Index(block, permutations)), threshold, item_type), schema) for block in item_blocks(items, block_chars=block_chars)]
    return reduce(DataFrame.unionAll, found)


def clean_column(items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, block_chars: int = BLOCK_CHARS):
    """A condition that is true for texts that no item leaks into; one pass for each block of items."""
    spark = items.sparkSession
    unnamed = items.select(F.lit(None).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    tests = [_clean(spark.sparkContext.broadcast(Index(block, permutations)), threshold, F.col(text_col)) for block in item_blocks(unnamed, block_chars=block_chars)]
    return reduce(lambda a, b: a & b, tests)


def _clean(index, threshold: float, text: Column) -> Column:
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _leaks(index, threshold, pa.null())
        for batch in texts:
            source = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), pa.array(batch, pa.string())], ["doc_id", "text"])
            verdict = np.ones(len(batch), bool)
            for out in run(iter([source])):
                verdict[out.column(0).to_numpy()] = False
            yield pd.Series(verdict)

    return F.pandas_udf(clean, "boolean").asNondeterministic()(text)
