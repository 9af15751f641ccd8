"""Language identification by prediction by partial matching (PPM).

Method. Every language has a byte context tree of variable order, up to ``ORDER`` bytes of context.
A symbol s after a context seen n times with d distinct successors costs -log2(c / (n + d)) bits if it
was seen c times there, and otherwise the escape -log2(d / (n + d)) plus its cost under the context
that is one byte shorter (PPM method C without exclusions; below order 0 each byte costs 8 bits; a
context that was never seen costs no escape). The statistics are frozen after training, so the cost
of a byte depends on the last ``ORDER + 1`` bytes alone. Costs of all windows seen in training are
computed once, for all languages together; scoring is a table lookup for each byte, and windows that
training hasn't seen fall back order by order. The code lengths are exact under the frozen trees.

Training draws a bounded, repeatable sample: about ``DOCS_PER_LANGUAGE`` distinct rows of each language by
a hash of the id and the text, so neither a repeated id nor a repeated row makes it larger. Rows without an id
are never drawn. All windows of the sample are kept, also those seen once, so every order's counts are
whole. The model's size is bounded by the sample, not by the corpus. With few languages it is a matrix of
windows by languages; beyond ``DENSE_CELLS`` cells only what each language has seen is stored, and a text
falls back order by order in each language on its own. Both give the same code lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import HashTable, free_names, hashed_share, held_out

ORDER = 4
DOCS_PER_LANGUAGE = 1500
#: Cells of (byte, language) that scoring holds at once.
CELLS = 4_000_000
#: Cells of (window, language) up to which the model is a matrix: 4 bytes each, held by the driver and every worker.
DENSE_CELLS = 60_000_000
#: A text is in none of the languages if every tree needs more bits than 8 for each of its bytes and so many more bytes.
SLACK_BYTES = 16
UNDETERMINED = "und"


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER + 1 bytes that end at each byte of the lower-cased texts, and bytes a text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    pad = b"\0" * ORDER
    data = np.frombuffer(pad + pad.join(raw), np.uint8)
    n = len(data) - ORDER
    key = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        key <<= 8
        key |= data[k : k + n]
    # the windows that end in the padding between two texts are left out
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
    for k in range(ORDER):
        keep[ends + k] = False
    return key[keep], sizes


class Level:
    """What the trees know of one order: costs of windows and escapes of contexts, as a matrix or by row."""

    def __init__(self, seen: list[tuple[np.ndarray, np.ndarray]]):
        """seen: by language, sorted distinct windows of this order and how often each was seen."""
        self.width = len(seen)
        self.windows = np.unique(np.concatenate([own for own, _ in seen]))
        self.contexts = np.unique(self.windows >> 8)
        window, context = [], []
        for j, (own, number) in enumerate(seen):
            prefix, at, distinct = np.unique(own >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=number, minlength=len(prefix))
            window.append((np.searchsorted(self.windows, own), j, -np.log2(number / (total + distinct)[at])))
            context.append((np.searchsorted(self.contexts, prefix), j, -np.log2(distinct / (total + distinct))))
        self.cost, self.escape = self._by_row(window, len(self.windows)), self._by_row(context, len(self.contexts))
        self.window_at, self.context_at = HashTable(self.windows), HashTable(self.contexts)
        self.matrix: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _by_row(parts: list[tuple[np.ndarray, int, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry of each row, and languages and values by row."""
        row = np.concatenate([at for at, _, _ in parts])
        language = np.concatenate([np.full(len(at), j, np.int16) for at, j, _ in parts])
        value = np.concatenate([v for _, _, v in parts]).astype(np.float32)
        order = np.argsort(row, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), language[order], value[order]

    @staticmethod
    def _spread(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of entries: position in ``rows``, language, value."""
        first, language, value = entries
        size = first[rows + 1] - first[rows]
        at = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(len(rows)), size), language[at], value[at]

    def fill(self, below: "Level | None", lower_mask: int) -> None:
        """Make the matrices, in which a language that hasn't seen a window has its cost by way of the order below."""
        escape = np.zeros((len(self.contexts), self.width), np.float32)
        at, language, value = self._spread(self.escape, np.arange(len(self.contexts)))
        escape[at, language] = value
        cost = escape[np.searchsorted(self.contexts, self.windows >> 8)]
        cost += 8.0 if below is None else below.matrix[0][np.searchsorted(below.windows, self.windows & lower_mask)]
        at, language, value = self._spread(self.cost, np.arange(len(self.windows)))
        cost[at, language] = value
        self.matrix = cost, escape


class Model:
    """Frozen trees of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], dense_cells: int = DENSE_CELLS):
        """counts: by language, sorted distinct window keys and how often each was seen."""
        self.languages = sorted(counts)
        self.levels: list[Level] = []
        for k in range(ORDER + 1 if counts else 0):
            seen = []
            for language in self.languages:
                keys, number = counts[language]
                own, at = np.unique(keys & self._mask(k), return_inverse=True)
                seen.append((own, np.bincount(at, weights=number, minlength=len(own))))
            self.levels.append(Level(seen))
        self.dense = sum(len(x.windows) + len(x.contexts) for x in self.levels) * len(self.languages) <= dense_cells
        if self.dense:
            for k, level in enumerate(self.levels):
                level.fill(self.levels[k - 1] if k else None, self._mask(k - 1))
            for level in self.levels:
                level.cost = level.escape = None  # all in the matrices

    @staticmethod
    def _mask(k: int) -> int:
        """The bytes of a window of order k."""
        return (1 << 8 * (k + 1)) - 1

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        return self._matrix_costs(keys) if self.dense else self._row_costs(keys)

    def _matrix_costs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        rows = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            cost, escape = level.matrix
            own = keys[rows] & self._mask(k)
            at = level.window_at.find(own)
            hit = at >= 0
            if k == ORDER and hit.all():
                return cost[at]
            out[rows[hit]] += cost[at[hit]]
            rows, own = rows[~hit], own[~hit]
            if not len(rows):
                return out
            at = level.context_at.find(own >> 8)
            out[rows[at >= 0]] += escape[at[at >= 0]]
        out[rows] += 8.0
        return out

    def _row_costs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.ones(out.shape, bool)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            own = keys & self._mask(k)
            for entries, table, key, last in ((level.cost, level.window_at, own, True), (level.escape, level.context_at, own >> 8, False)):
                at = table.find(key)
                rows = np.flatnonzero(at >= 0)
                which, language, value = level._spread(entries, at[rows])
                row = rows[which]
                on = todo[row, language]
                row, language = row[on], language[on]
                out[row, language] += value[on]
                if last:
                    todo[row, language] = False
        out[todo] += 8.0
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of every text under every language, in bits, and its length in bytes."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        limit = max(1, CELLS // max(1, len(self.languages)))
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) <= limit):
                held += len(texts[b])
                b += 1
            keys, own = _windows(texts[a:b])
            sizes[a:b] = own
            owner = np.repeat(np.arange(b - a), own)
            for c in range(0, len(keys), limit):
                part, to = self._costs(keys[c : c + limit]), owner[c : c + limit]
                heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                total[a + to[heads]] += np.add.reduceat(part, heads, axis=0, dtype=np.float64)
            a = b
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of every text; ``und``, 0 and 8 without a letter."""
        language, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        if rows:
            bits, sizes = self.bits([texts[i] for i in rows])
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(rows)), best]
            score[rows] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            rate[rows] = least / sizes
            for i, j in zip(rows, best.tolist()):
                language[i] = self.languages[j]
        return language, score, rate


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(language, []).append(text)
        for language, texts in by.items():
            keys, number = np.unique(_windows(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys)), pa.array(keys), pa.array(number.astype(np.int64))], ["lang", "key", "n"])


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, min_count: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trees from a bounded sample of the rows with a language that are not held out; a ``min_count`` over 1 drops rarer windows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    number = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not number:
        return Model({})
    share = F.create_map(*[F.lit(x) for k, n in number.items() for x in (k, min(1.0, docs_per_language / n))])
    drawn = rows.filter(F.col("text").isNotNull() & (hashed_share(F.col("doc_id"), F.col("text")) < share[F.col("lang")]))
    # repeated rows are folded before the shuffle
    sample = drawn.select("lang", "text", F.col("doc_id").cast("string").alias("doc_id")).distinct().select("lang", "text")
    seen = sample.mapInArrow(_count_windows, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    # languages reach the driver as numbers
    names = sorted(number)
    code = F.create_map(*[F.lit(x) for j, name in enumerate(names) for x in (name, j)])
    got = seen.select(code[F.col("lang")].alias("lang"), "key", "n").toArrow()
    language, keys, n = (got[c].to_numpy() for c in ("lang", "key", "n"))
    order = np.lexsort((keys, language))
    language, keys, n = language[order], keys[order], n[order]
    cuts = np.searchsorted(language, np.arange(len(names) + 1))
    return Model({name: (keys[a:b], n[a:b]) for name, a, b in zip(names, cuts.tolist(), cuts[1:].tolist()) if a < b})


def predict_column(model: Model, docs: DataFrame, text: Column) -> Column:
    """struct(lang_pred, score, bits_per_byte) of a text column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            language, score, rate = shared.value.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": language, "score": score, "bits_per_byte": rate})

    return F.pandas_udf(predict, "lang_pred string, score double, bits_per_byte double").asNondeterministic()(text)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs, with their columns, that are in one of the languages learned from docs.

    Out go rows without a letter or text, and rows whose text costs more under every tree than 8 bits for each of its
    bytes and ``SLACK_BYTES`` more, at any length. If there is nothing to learn from, all rows go.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    (p,) = free_names(docs.columns, "p")
    judged = docs.withColumn(p, predict_column(model, docs, F.col(text_col)))
    n = F.octet_length(F.col(text_col))
    foreign = F.col(p)["bits_per_byte"] * n > 8.0 * (n + SLACK_BYTES)
    return judged.filter((F.col(p)["lang_pred"] != UNDETERMINED) & ~foreign).drop(p)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1), bits_per_byte.

    The score is the share of the winner when 2 ** -bits is shared out among the languages; ties go
    to the language that sorts first. A null text, or one without a letter, is ``und`` with score 0
    and 8 bits a byte, and so is every row if there is nothing to learn from. Repeated rows stay; a
    row with a null doc_id is predicted, counts as not held out, and is never drawn for training.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), predict_column(model, docs, F.col(text_col)).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.bits_per_byte")
