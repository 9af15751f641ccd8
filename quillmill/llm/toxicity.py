"""Toxicity scores of texts restored by a noisy-channel decoder.

Method. A writer who hides a word is a noisy channel: letters become look-alikes (1d10t), are
repeated (stuuupid) or spaced out (i d i o t, i-d-i-o-t). A token that shows such signs becomes a
character lattice: every look-alike may stand for several letters, a long run for one or two
letters, any other character between letters (a separator) for nothing or for a word break, each at a
channel cost; digits and marks of other scripts stay, an apostrophe alone is no sign. Viterbi decoding
under a character trigram model, counted over all documents, picks the restored text, in time linear in
the length of a token or spaced-out run, whatever that is. Tokens without such signs have one path and
are left alone.

The restored text is scored by logistic regression over the presence of character n-grams of words
and of whole words, so an unseen inflection of a known stem still counts. An n-gram is a feature if its
log-likelihood ratio exceeds the logarithm of the number of labelled documents, the Bayesian information
criterion for one more parameter, so the bar falls and rises with the labels there are; how many pass is
bounded by the sample, not by a number. Labels are learned only from rows whose crc32(doc_id) mod 5 is not
0, from a bounded, repeatable sample of about ``DOCS_PER_CLASS`` labelled documents of each class. A score
looks up the n-grams of each distinct token of the whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import hashed_share, held_out, settle

DOCS_PER_CLASS = 3000
#: Toxic documents of the sample that a feature must be seen in.
MIN_DOCS = 3
RIDGE = 0.1
_MEMO = 200_000
#: Longer tokens are decoded, and longer words looked up, like all others, but not remembered.
_MEMO_LENGTH = 64
#: Characters of the longest n-gram.
GRAM = 6
#: Longer words are no feature as a whole; their n-grams are.
WHOLE_WORD = 40

# Look-alike characters and the letters they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Spelling, not noise: a token with no other sign is left alone.
APOSTROPHES = "'\u2019\u02bc"
#: Costs, in nats, of a look-alike, of dropping a separator or a repetition, and of a word break at a separator.
COST_LOOKALIKE, COST_DROP, COST_BREAK = 1.0, 0.5, 1.0

# The model's symbols: 0 a word break, 1-26 a-z, 27-58 the letters from U+00DF to U+00FF, 63 the rest.
SYMBOLS = 64
_SYMBOL = np.full(0x250, SYMBOLS - 1, np.uint8)
_SYMBOL[:0x80] = 0
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[0xDF:0x100] = np.arange(27, 27 + 33)
_SYMBOL[0xA0:0xC0] = 0

_EDGES = "\"'([{<>)]}.,;:?!`^~_-*"
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\S)|(?<!\S)[\w@$!|](?: [\w@$!|]){3,}(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_DECORATION = re.compile(r"([^\w\s])\1\1+$")


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts = [t.lower() for t in batch.column(0).to_pylist() if t]
        for a in range(0, len(texts), 500):
            points = np.frombuffer(("  " + "  ".join(texts[a : a + 500]) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
            s = _SYMBOL[np.minimum(points, len(_SYMBOL) - 1)].astype(np.int32)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    key = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs in nats of symbol c after a, b, counted over all of docs; at most 64 ** 3 numbers reach the driver."""
    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(trigram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    n3 = np.zeros(SYMBOLS**3)
    n3[seen["key"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
    n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2 = n3.sum(axis=0)
    p1 = (n2.sum(axis=0) + 1) / (n2.sum() + SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


class Decoder:
    """Restores texts under a character model; keeps a bounded memo of tokens."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.memo: dict[str, str] = {}

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]] | None:
        """Alternatives (string, channel cost) of each place of a token; None without a sign of noise."""
        slots: list[list[tuple[str, float]]] = []
        noisy, letters, i = False, 0, 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            reads = LOOKALIKES.get(c)
            if c.isalpha():
                letters += j - i
                if j - i >= 3:
                    noisy = True
                    slots.append([(c, COST_DROP), (c * 2, COST_DROP)])
                else:
                    slots.extend([(c, 0.0)] for _ in range(j - i))
            elif reads:
                noisy = True
                alternatives = [(r, COST_LOOKALIKE) for r in reads]
                if j - i >= 3:
                    slots.append([(r * k, cost + COST_DROP) for r, cost in alternatives for k in (1, 2)])
                else:
                    slots.extend(list(alternatives) for _ in range(j - i))
            elif c.isalnum() or unicodedata.category(c)[0] == "M":
                # other digits and marks that belong to a letter
                slots.extend([(c, 0.0)] for _ in range(j - i))
            else:
                noisy = noisy or c not in APOSTROPHES
                slots.append([("", COST_DROP), (" ", COST_BREAK)])
            i = j
        return slots if noisy and letters else None

    def decode(self, slots: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading: Viterbi over the last two symbols."""
        symbol = lambda c: int(_SYMBOL[min(ord(c), len(_SYMBOL) - 1)])
        costs = self.costs
        best = {(0, 0): (0.0, None)}
        for slot in [*slots, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, back) in best.items():
                for reading, channel in slot:
                    x, y, z = a, b, cost + channel
                    for c in reading:
                        s = symbol(c)
                        z += costs[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or z < after[x, y][0]:
                        after[x, y] = (z, (back, reading))
            best = after
        back = min(best.values(), key=lambda v: v[0])[1]
        out = []
        while back is not None:
            back, reading = back
            out.append(reading)
        return "".join(reversed(out)).strip()

    def read(self, token: str) -> str:
        """As token(), without the memo."""
        if token.isalpha() and not _RUN.search(token):
            return token
        core = token.strip(_EDGES)
        if core.isalpha() and not _RUN.search(core):
            return core
        # three or more equal symbols at the end decorate a word
        core = _DECORATION.sub("", core)
        slots = self.lattice(core)
        return self.decode(slots) if slots else core

    def token(self, token: str) -> str:
        """A lower-case token without white space, restored; edge punctuation of a noisy token goes."""
        if token.isalpha() and not _RUN.search(token):
            return token
        got = self.memo.get(token)
        if got is None:
            got = self.read(token)
            if len(token) <= _MEMO_LENGTH:
                if len(self.memo) > _MEMO:
                    self.memo.clear()
                self.memo[token] = got
        return got

    def words(self, text: str | None) -> list[str]:
        """The words of the restored text."""
        out = []
        for token in self.tokens(text):
            if token.isalpha() and not _RUN.search(token):
                out.append(token)
            else:
                out.extend(self.token(token).split())
        return out

    def tokens(self, text: str | None) -> list[str]:
        """The lower-case tokens of the text, spaced-out runs joined."""
        return _SPACED.sub(lambda m: self._joined(m.group()), (text or "").lower()).split()

    def _joined(self, run: str) -> str:
        slots = self.lattice(run)
        return self.decode(slots) if slots else run

    def restore(self, text: str | None) -> str:
        return " ".join(self.words(text))


def word_features(word: str) -> set[str]:
    """n-grams of three to six characters of the whole of ^word$, and, up to ``WHOLE_WORD`` characters, the word itself."""
    marked = f"^{word}$"
    grams = {marked[i : i + n] for n in range(3, GRAM + 1) for i in range(len(marked) - n + 1)}
    return grams | {marked} if len(word) <= WHOLE_WORD else grams


class Scorer:
    """Selected features with weights; a text's score is the logistic of the weights it shows."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], bias: float):
        self.costs, self.weights, self.bias = costs, weights, bias
        self._decoder: Decoder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_decoder": None, "_memo": None, "_grams": None}

    def _prepare(self) -> None:
        self._decoder, self._memo = Decoder(self.costs), {}
        self._grams = ahocorasick.Automaton()
        for feature in self.weights:
            if len(feature) <= GRAM:  # a longer one is a whole word
                self._grams.add_word(feature, feature)
        self._grams.make_automaton()

    def known(self, word: str) -> set[str]:
        """The features of word_features(word) that are selected, in one pass over the word."""
        marked = f"^{word}$"
        found = {gram for _, gram in self._grams.iter(marked)} if len(self._grams) else set()
        if len(word) <= WHOLE_WORD and marked in self.weights:
            found.add(marked)
        return found

    def features(self, text: str | None) -> set[str]:
        if self._decoder is None:
            self._prepare()
        memo, found = self._memo, set()
        for token in set(self._decoder.tokens(text)):
            own = memo.get(token)
            if own is None:
                own = tuple({f for word in self._decoder.read(token).split() for f in self.known(word)})
                if len(token) <= _MEMO_LENGTH:
                    if len(memo) > _MEMO:
                        memo.clear()
                    memo[token] = own
            if own:
                found.update(own)
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.features(text))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _document_counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[str] = set()
                for word in set(decoder.words(text)):
                    found |= word_features(word)
                (toxic if label else clean).update(found)
        keys = sorted(toxic)  # a feature that no toxic document shows is never selected
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], ["feature", "toxic", "clean"])
        keys = sorted(clean)
        for a in range(0, len(keys), 200_000):
            part = keys[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["feature", "toxic", "clean"])

    return run


def _select(counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """Features that toxic documents show more often than chance allows, by log-likelihood ratio."""
    rate = F.lit(toxic / (toxic + clean))
    both = F.col("toxic") + F.col("clean")
    term = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (term(F.col("toxic"), both * rate) + term(F.col("clean"), both * (1 - rate)))
    telling = (F.col("toxic") >= MIN_DOCS) & (F.col("toxic") > both * rate) & (ratio > math.log(toxic + clean))
    return sorted(r.feature for r in counts.filter(telling).select("feature").collect())


def _fit(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adagrad over presence features: features of all rows one after the other, their number a row, labels, weights."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    weight = weight / weight.mean()
    w, b = np.zeros(width), math.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))
    past_w, past_b = np.full(width, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(of, weights=w[at], minlength=len(sizes)) if len(at) else np.full(len(sizes), b)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gw = (np.bincount(at, weights=error[of], minlength=width) if len(at) else np.zeros(width)) + RIDGE * w
        gb = error.sum()
        past_w += gw**2
        past_b += gb**2
        w -= 0.3 * gw / np.sqrt(past_w)
        b -= 0.3 * gb / math.sqrt(past_b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Character model from all texts, weights from a bounded sample of the labels that may be learned."""
    spark = docs.sparkSession
    costs = language_model(docs, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id", "toxic"])
    number = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(number) < 2:
        return Scorer(costs, {}, 20.0 if number.get(1) else -20.0)
    share = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / number[1])).otherwise(min(1.0, docs_per_class / number[0]))
    # about two classes of docs_per_class ids, whatever the input: bounded, so it may be broadcast
    ids = F.broadcast(known.filter(hashed_share(F.col("doc_id")) < share))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id")
    # an id may have many rows: they are counted without their texts, then thinned by id and text
    count = {r.toxic: r["count"] for r in named.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return Scorer(costs, {}, 20.0 if number.get(1, 0) > number.get(0, 0) else -20.0)
    thin = F.when(F.col("toxic") == 1, 2 * docs_per_class / count[1]).otherwise(2 * docs_per_class / count[0])
    drawn = named.filter(hashed_share(F.col("doc_id"), F.coalesce("text", F.lit(""))) < thin)
    # repeated rows are folded before the shuffle
    rows = settle(drawn.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic").distinct().select("text", "toxic"), "toxic-sample")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Scorer(costs, {}, 20.0 if number.get(1, 0) > number.get(0, 0) else -20.0)
    shared = spark.sparkContext.broadcast(costs)
    counts = rows.mapInArrow(_document_counts(shared), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    features = _select(counts, size[1], size[0])
    # the finder's weights are the places of the features
    finder = spark.sparkContext.broadcast(Scorer(costs, {f: float(j) for j, f in enumerate(features)}, 0.0))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = finder.value
            found = [np.array(sorted(own.weights[f] for f in own.features(t)), np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["places", "toxic"])

    # the sample's rows, each as packed numbers of its features, in an order that doesn't depend on tasks
    seen = rows.mapInArrow(shown, "places binary, toxic int").toArrow().sort_by([("toxic", "ascending"), ("places", "ascending")])
    places = seen["places"].to_pylist()
    at, sizes, y = np.frombuffer(b"".join(places), np.int32), np.array([len(p) // 4 for p in places], np.int64), seen["toxic"].to_numpy().astype(float)
    # the sample's classes count as they do among all labels
    w, b = _fit(at, sizes, y, np.where(y == 1, number[1] / size[1], number[0] / size[0]), len(features))
    return Scorer(costs, dict(zip(features, w.tolist())), b)


def score_column(scorer: Scorer, docs: DataFrame, text: Column) -> Column:
    """Toxicity of a text column of docs, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return F.pandas_udf(score, "double").asNondeterministic()(text)


def restore_column(costs: np.ndarray, docs: DataFrame, text: Column) -> Column:
    """The restored, lower-case text of a text column of docs; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def restore(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in texts:
            yield pd.Series([None if t is None else decoder.restore(t) for t in batch], dtype="object")

    return F.pandas_udf(restore, "string").asNondeterministic()(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5).

    Null and empty texts get the score of a text without any feature. Repeated rows stay; a row with a
    null doc_id is scored, counts as not held out and is never learned from; a repeated label counts
    once, contradicting labels of a document count once each, other labels than 0 and 1 not at all.
    With one class only, or no labels, every text gets a score near that class, or near 0. Other
    columns are ignored, whatever their names; an empty table of documents gives an empty result.
    """
    scorer = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), score_column(scorer, docs, F.col(text_col)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
