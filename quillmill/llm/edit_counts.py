"""Edit-aware token counts.

Method. A public byte-level vocabulary cuts a text into pre-tokens by a pattern and encodes each on
its own, so a text's token count is the sum over its pre-tokens. Each document keeps a segment tree: leaves
hold short runs of pre-tokens, inner nodes the sums of characters and tokens below them. An edit
descends by character sums to its leaf, steps back over the boundary context (a pre-token depends
on at most ``CONTEXT`` characters after its end), re-splits from there until a boundary meets an old
one behind the edit, encodes only the pre-tokens in between, and updates the sums on the leaves' paths.

The trees are a table: build_trees() encodes every text once; apply_edits() reads trees and a table of edits and
gives new trees. A tree that is read again knows the sizes and counts of its pre-tokens, so a later round of
edits splits and encodes nothing but the touched places, and even cuts only the leaves it touches.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.llm.common import settle, unsettle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32
#: Characters behind a pre-token's end that can change where it ends (two letters of a contraction).
CONTEXT = 2
_MEMO = 300_000

# Fixed value: the pattern that public byte-level vocabularies of this kind split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split in the standard library's syntax, for texts of characters on which both agree.
_PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_OTHER = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")

#: Edits of one document that a task takes at once; more are applied in further rounds.
ROUND = 10_000

EDITS = "array<struct<pos: long, remove: long, insert: string>>"
FIELDS = "n_tokens long, n_tokens_after long, n_chars_after long, n_pretokens long, reencoded_pretokens long"
#: A stored tree: the text, sizes and counts of its pre-tokens (see pack()), sums of its leaves and of the root.
TREE = "text string, sizes binary, counts binary, leaf_chars array<int>, leaf_tokens array<int>, n_chars long, n_tokens long, n_pretokens long"


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def pack(numbers: np.ndarray) -> bytes:
    """Small numbers as bytes: 255 for each 255 in a number, then the rest."""
    if not len(numbers) or numbers.max() < 255:
        return numbers.astype(np.uint8).tobytes()
    out = np.full(int((numbers // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(numbers // 255 + 1) - 1] = numbers % 255
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(held != 255)
    if len(last) == len(held):
        return held.astype(np.int64)
    return np.add.reduceat(held.astype(np.int64), np.concatenate(([0], last[:-1] + 1)))


class Counter:
    """Splits texts into pre-tokens and counts their tokens, with a bounded memo."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.exact.findall(text) if _OTHER.search(text) else _PLAIN.findall(text)

    def counts(self, pretokens: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for p in set(pretokens).difference(memo):
            memo[p] = len(self.encoding.encode_ordinary(p))
        return list(map(memo.__getitem__, pretokens))


class Tree:
    """Segment tree over the pre-tokens of one document. Leaves are cut into pre-tokens where an edit touches them."""

    def __init__(self, text: str, counter: Counter, sizes: np.ndarray | None = None, counts: np.ndarray | None = None):
        """sizes, counts: of the pre-tokens, if they are known."""
        self.counter, self.reencoded = counter, 0
        if sizes is None:
            pretokens = counter.split(text)
            sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
            counts = np.array(counter.counts(pretokens), np.int64)
        self._lay(text, sizes, counts)

    def _lay(self, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Lay leaves of LEAF pre-tokens over a text."""
        self.source, self.sizes, self.own = text, sizes, counts
        self.touched: dict[int, tuple[list[str], list[int]]] = {}
        self.n_pretokens = len(sizes)
        cuts = np.arange(0, len(sizes), LEAF)
        chars = np.add.reduceat(sizes, cuts).tolist() if len(sizes) else [0]
        tokens = np.add.reduceat(counts, cuts).tolist() if len(sizes) else [0]
        self.n_leaves = len(chars)
        self.starts = np.concatenate(([0], np.cumsum(chars))).tolist()
        self.size = 1 << max(0, self.n_leaves - 1).bit_length()
        fill = [0] * (self.size - self.n_leaves)
        self.chars, self.tokens = [0] * self.size + chars + fill, [0] * self.size + tokens + fill
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _leaf(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens of a leaf and their counts."""
        if k in self.touched:
            return self.touched[k]
        at, out = self.starts[k], []
        for size in self.sizes[k * LEAF : (k + 1) * LEAF].tolist():
            out.append(self.source[at : at + size])
            at += size
        return out, self.own[k * LEAF : (k + 1) * LEAF].tolist()

    def pretokens(self) -> list[str]:
        return [p for k in range(self.n_leaves) for p in self._leaf(k)[0]]

    def whole(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text as edited, sizes and counts of its pre-tokens; leaves that no edit has touched are copied as they lie."""
        text, sizes, counts, k = [], [], [], 0
        for t in [*sorted(self.touched), self.n_leaves]:
            text.append(self.source[self.starts[k] : self.starts[t]])
            sizes.append(self.sizes[k * LEAF : t * LEAF])
            counts.append(self.own[k * LEAF : t * LEAF])
            if t < self.n_leaves:
                leaf, own = self.touched[t]
                text += leaf
                sizes.append(np.fromiter(map(len, leaf), np.int64, len(leaf)))
                counts.append(np.array(own, np.int64))
            k = t + 1
        return "".join(text), np.concatenate(sizes), np.concatenate(counts)

    def text(self) -> str:
        return self.whole()[0]

    def stored(self) -> tuple:
        """The values of TREE, in leaves of LEAF pre-tokens again."""
        if self.touched:
            self._lay(*self.whole())
        leaves = slice(self.size, self.size + self.n_leaves)
        return self.source, pack(self.sizes), pack(self.own), self.chars[leaves], self.tokens[leaves], self.n_chars, self.n_tokens, self.n_pretokens

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character at pos (the last one for the end), and where it starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if pos >= start + self.chars[k] and k + 1 < 2 * self.size and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.size, self.n_leaves - 1), start

    def _put(self, k: int, leaf: list[str], counts: list[int]) -> None:
        self.touched[k] = leaf, counts
        k += self.size
        self.chars[k], self.tokens[k] = sum(map(len, leaf)), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, pos: int, remove: int, insert: str) -> None:
        """Replace ``remove`` characters at ``pos``; both are clipped to the text."""
        pos = min(max(pos, 0), self.n_chars)
        remove = min(max(remove, 0), self.n_chars - pos)
        first, start = self._leaf_at(max(0, pos - CONTEXT - 1))
        while first and pos - start <= CONTEXT:
            first -= 1
            start -= self.chars[self.size + first]
        last, _ = self._leaf_at(pos + remove)
        last = max(first, last)
        old, own = [], []
        for k in range(first, last + 1):
            leaf, counts = self._leaf(k)
            old += leaf
            own += counts
        before = len(old)
        # pre-tokens that end far enough before the edit stay
        keep, at = 0, start
        while keep < len(old) and at + len(old[keep]) + CONTEXT <= pos:
            at += len(old[keep])
            keep += 1
        while True:
            region = "".join(old[keep:])
            changed = region[: pos - at] + insert + region[pos - at + remove :]
            new = self.counter.split(changed)
            shift = len(insert) - remove
            ends, e = {}, at
            for k in range(keep, len(old)):
                e += len(old[k])
                ends[e + shift] = k + 1
            e, meet = at, None
            behind = pos + len(insert)
            whole = last + 1 >= self.n_leaves
            limit = at + len(changed)
            for k, p in enumerate(new):
                e += len(p)
                # the last few boundaries of a part of the text may lie elsewhere in the whole text
                if e >= behind and e in ends and (whole or e + CONTEXT < limit):
                    meet = (k + 1, ends[e])
                    break
            if meet or whole:
                break
            last += 1
            leaf, counts = self._leaf(last)
            old += leaf
            own += counts
            before += len(leaf)
        take, rest = meet or (len(new), len(old))
        fresh = self.counter.counts(new[:take])
        self.reencoded += take
        old[keep:rest], own[keep:rest] = new[:take], fresh
        self.n_pretokens += len(old) - before
        leaves = last - first + 1
        share = -(-len(old) // leaves) if old else 0
        for k in range(leaves):
            self._put(first + k, old[k * share : (k + 1) * share], own[k * share : (k + 1) * share])
        if share > 8 * LEAF:
            self._lay(*self.whole())


_held: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    return _held.get(path) or _held.setdefault(path, Counter(path))


def tree_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """struct of TREE of a text; a null text is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.DataFrame([Tree(t or "", own).stored() for t in texts], columns=names_of(TREE), dtype="object")

    return F.pandas_udf(run, TREE).asNondeterministic()(text)


def _edited(row: tuple, edits, own: Counter) -> Tree:
    tree = Tree(row[0], own, unpack(row[1]), unpack(row[2]))
    for e in edits if edits is not None else ():
        if e is not None:
            tree.edit(int(e["pos"] or 0), int(e["remove"] or 0), e["insert"] or "")
    return tree


def edited_column(tree: list[Column], edits: Column, vocabulary: str = VOCABULARY, stored: bool = True) -> Column:
    """struct of FIELDS, and of TREE if stored, for a stored tree's text, sizes and counts and a list of edits that apply one after the other."""
    fields = f"{FIELDS}, {', '.join(f'{n}_new {k}' for n, k in (f.split(' ', 1) for f in TREE.split(', ')))}" if stored else FIELDS

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for *held, lists in batches:
            rows = []
            for *row, edits in zip(*held, lists):
                tree = _edited(row, edits, own)
                kept = tree.stored() if stored else ()
                rows.append((row[3], tree.n_tokens, tree.n_chars, tree.n_pretokens, tree.reencoded, *kept))
            yield pd.DataFrame(rows, columns=names_of(fields), dtype="object")

    return F.pandas_udf(run, fields).asNondeterministic()(*tree, edits)


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and TREE of each row of docs; to be written where edits are to come. A null text is empty, repeated rows and null ids stay."""
    return docs.select(F.col(id_col).alias("doc_id"), tree_column(F.col(text_col), vocabulary).alias("t")).select("doc_id", "t.*")


def _rounds(edits: DataFrame, id_col: str) -> list[DataFrame]:
    """Tables (doc_id, edits) of at most ``ROUND`` edits a document, in the order in which they apply."""
    own = edits.select(F.col(id_col).alias("doc_id"), "seq", F.col("pos").cast("long").alias("pos"), F.col("remove").cast("long").alias("remove"), "insert").filter("doc_id IS NOT NULL")
    # sorted outside memory if need be: a document may have any number of edits
    numbered = own.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "pos", "remove", "insert")))
    numbered = settle(numbered.select("doc_id", "n", "pos", "remove", "insert"), "edits")
    most = numbered.agg(F.max("n")).first()[0] or 0
    lists = []
    for a in range(0, most, ROUND):
        part = numbered.filter((F.col("n") > a) & (F.col("n") <= a + ROUND)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pos", "remove", "insert"))).alias("e"))
        lists.append(part.select("doc_id", F.transform("e", lambda e: F.struct(e["pos"].alias("pos"), e["remove"].alias("remove"), e["insert"].alias("insert"))).cast(EDITS).alias("edits")))
    return lists


def _apply(rows: DataFrame, vocabulary: str, stored: bool) -> DataFrame:
    """doc_id and FIELDS, and the new tree if stored, of rows (doc_id, TREE, edits)."""
    tree = [F.col(c) for c in ("text", "sizes", "counts", "n_tokens")]
    done = rows.select("doc_id", edited_column(tree, F.col("edits"), vocabulary, stored).alias("c")).select("doc_id", "c.*")
    if not stored:
        return done
    return done.select("doc_id", F.col("n_tokens").alias("n_tokens_before"), "reencoded_pretokens", *[F.col(f"{n}_new").alias(n) for n in names_of(TREE)])


def apply_edits(trees: DataFrame, edits: DataFrame | Column, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """Trees (doc_id, TREE) after edits, with n_tokens_before and reencoded_pretokens; edits as in edit_counts().

    Only pre-tokens that an edit touches, and their boundary context, are split and encoded; a document
    without edits is copied. The vocabulary must be the one that the trees were built with. trees should be a
    written table. More than ``ROUND`` edits of a document are applied in rounds, settled one after the other.
    """
    if isinstance(edits, Column):
        return _apply(trees.withColumn("edits", edits.cast(EDITS)), vocabulary, True)
    before = trees.withColumn("n_tokens_before", F.col("n_tokens")).withColumn("reencoded_pretokens", F.lit(0).cast("long"))
    lists, now, held = _rounds(edits, id_col), before, None
    for k, part in enumerate(lists):
        rows = now.join(part, "doc_id", "left").withColumn("key", F.struct("n_tokens_before", "reencoded_pretokens"))
        tree = [F.col(c) for c in ("text", "sizes", "counts", "n_tokens")]
        done = rows.select("doc_id", "key", edited_column(tree, F.col("edits"), vocabulary).alias("c"))
        now = done.select("doc_id", F.col("key.n_tokens_before"), (F.col("key.reencoded_pretokens") + F.col("c.reencoded_pretokens")).alias("reencoded_pretokens"), *[F.col(f"c.{n}_new").alias(n) for n in names_of(TREE)])
        if k + 1 < len(lists):
            now, last = settle(now, "trees"), held
            held = now
            if last is not None:
                unsettle(last)
    return now.select("doc_id", "n_tokens_before", "reencoded_pretokens", *names_of(TREE))


def edit_counts(docs: DataFrame, edits: DataFrame | Column, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tokens before and after the edits, characters after, pre-tokens, re-encoded pre-tokens.

    edits: a column over doc_id and text, of type EDITS, or a table (doc_id, seq, pos, remove, insert) of which a
    document's rows apply in the order of seq (ties: by pos, remove, insert). Positions are in
    characters of the text as edited so far, and are clipped to it; a null position or length is 0, a
    null insertion is empty. A null text counts as empty. Edits without a document are ignored, each of
    repeated documents gets all edits of its id, a document without edits keeps its count. Other columns
    are ignored, whatever their names; an empty table of documents gives an empty result.
    """
    trees = settle(build_trees(docs, vocabulary, id_col, text_col), "trees")
    if isinstance(edits, Column):
        return _apply(trees.withColumn("edits", edits.cast(EDITS)), vocabulary, False)
    done = apply_edits(trees, edits, vocabulary, id_col)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("n_chars").alias("n_chars_after"), "n_pretokens", "reencoded_pretokens")


def planned_edits(text: Column) -> Column:
    """Three repeatable edits of a text: a replacement in its first third, a contraction put in near its end, a deletion at its start."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda pos, remove, insert: F.struct(pos.cast("long").alias("pos"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(F.floor(n / 3), 7, " (as amended in 2024) "), edit(n - F.floor(n / 5), 0, "'ll "), edit(F.lit(0), 2, ""))
