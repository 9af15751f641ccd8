"""Quality rules from tokeniser fertility.

Method. Public vocabularies, one of pieces and one of byte sequences, measure every text: characters per
token, the share of tokens that are fallback bytes (single bytes of a character that has no token), and
the entropy of the token distribution as a share of the largest that a text of so many tokens can have.
Neither vocabulary joins across white space, so the tokens of a text are those of its words, each with
the space before it; a bounded memo of words saves encoding them again.

Rejection bands are set per language (or per script where the language is null) from all texts that
pass the base rules: for each measure of each vocabulary, the quartiles widened by ``BAND_WIDTH``
interquartile ranges and by a fixed slack. The quartiles come from counts of rounded measures, so they
don't depend on the order of rows. A text is kept if it passes the base rules and all its measures lie in the bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import settle
from quillmill.llm.edit_counts import counter

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Files of a piece vocabulary and of a byte-sequence one.
VOCABULARIES = ("/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BAND_WIDTH = 2.5
#: Measures, the steps in which they are counted, and the least slack of their bands.
MEASURES = {
    "chars_per_token": (0.01, 0.0), "byte_share": (0.001, 0.03), "entropy_share": (0.001, 0.05),
    "seq_chars_per_token": (0.01, 0.0), "seq_byte_share": (0.001, 0.03), "seq_entropy_share": (0.001, 0.05),
}
_MEMO = 200_000
_WHITE = " \t\n\x0b\x0c\r"

MEASURE_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy_share double, "
    "seq_tokens long, seq_chars_per_token double, seq_byte_share double, seq_entropy_share double, script string"
)

# First code points of the ranges in which a script's letters lie.
SCRIPTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):
        # pairs are numbered anew each time, so the key never overflows
        _, key = np.unique(key * len(number) + ids[k : k + n], return_inverse=True)
    hit = np.bincount(key)[key] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _WHITE))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return words, (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def script_of(text: str) -> str:
    """The script of most letters; ``none`` without a letter, the first by name in a tie."""
    letters = "".join(c for c in set(text) if c.isalpha())
    if not letters:
        return "none"
    if max(letters) < "Ͱ":
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[np.isin(points, np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32))]
    found = np.bincount(np.maximum(np.searchsorted(_STARTS, points, side="right") - 1, 0), minlength=len(SCRIPTS))
    by: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, found.tolist()):
        by[name] = by.get(name, 0) + n
    return min(by, key=lambda k: (-by[k], k))


class PieceVocabulary:
    """A sentencepiece vocabulary; a piece that opens with the space sign begins a word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.opens = np.array([p.startswith("▁") for p in pieces])
        self.size = np.array([1 if byte else len(p.replace("▁", " ").encode()) for p, byte in zip(pieces, self.is_byte)])

    def together(self, words: list[str]) -> list[int]:
        return self.model.encode(" ".join(words))

    def one(self, word: str) -> list[int]:
        return self.model.encode(word)


class ByteVocabulary:
    """A byte-sequence vocabulary; as words hold no space, a token that opens with one begins a word."""

    def __init__(self, path: str):
        self.encoding = counter(path).encoding
        tokens = [self.encoding.decode_single_token_bytes(i) for i in range(self.encoding.n_vocab)]
        self.is_byte = np.array([len(t) == 1 and t[0] >= 0x80 for t in tokens])
        self.opens = np.array([t.startswith(b" ") for t in tokens])
        self.size = np.array(list(map(len, tokens)))

    def together(self, words: list[str]) -> list[int]:
        return self.encoding.encode_ordinary(" " + " ".join(words))

    def one(self, word: str) -> list[int]:
        return self.encoding.encode_ordinary(f" {word}")


def encode_words(vocabulary: PieceVocabulary | ByteVocabulary, words: list[str]) -> list[bytes]:
    """Ids of each word, as packed int32. All words are encoded in one call and cut where tokens begin a word; if the
    tokens of a cut aren't as long as its word and the space before it, the words are encoded one by one."""
    ids = np.array(vocabulary.together(words), np.int32)
    cuts = np.flatnonzero(vocabulary.opens[ids])
    if len(cuts) == len(words):
        lengths = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
        if cuts[0] == 0 and (np.add.reduceat(vocabulary.size[ids], cuts) == lengths).all():
            return [ids[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)])]
    return [np.array(vocabulary.one(w), np.int32).tobytes() for w in words]


class Vocabularies:
    """The vocabularies with one bounded memo: word -> its ids in each, packed."""

    def __init__(self, paths: tuple[str, ...] = VOCABULARIES):
        self.own = [PieceVocabulary(p) if p.endswith(".model") else ByteVocabulary(p) for p in paths]
        self.memo: dict[bytes, tuple[bytes, ...]] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        for a in range(0, len(new), 2000):
            part = new[a : a + 2000]
            plain = [w.decode("utf-8", "replace") for w in part]
            self.memo.update(zip(part, zip(*(encode_words(v, plain) for v in self.own))))

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of the words in each vocabulary."""
        self.learn(set(words))
        found = [self.memo[w] for w in words]
        return [np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in range(len(self.own))]


def fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple:
    """Tokens, characters per token, byte share and entropy share."""
    n = len(ids)
    if not n:
        return 0, None, None, None
    seen = np.bincount(ids) if n >= 2_000 else np.unique(ids, return_counts=True)[1]
    seen = seen[seen > 0] / n
    entropy = float(-(seen * np.log2(seen)).sum())
    top = float(np.log2(min(n, len(is_byte))))
    return n, chars / n, float(is_byte[ids].mean()), entropy / top if top else 1.0


def measure(text: str | None, vocabularies: Vocabularies) -> tuple:
    """The values of MEASURE_FIELDS."""
    words, counts = base_counts(text)
    found = [fertility(ids, counts[1], v.is_byte) for ids, v in zip(vocabularies.ids(words), vocabularies.own)]
    return (*counts, *found[0], *found[1], script_of(text or ""))


_held: dict[tuple[str, ...], Vocabularies] = {}


def measure_column(text: Column, vocabularies: tuple[str, str] = VOCABULARIES) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _held.get(vocabularies) or _held.setdefault(vocabularies, Vocabularies(vocabularies))
        for batch in texts:
            yield pd.DataFrame([measure(t, own) for t in batch], columns=[f.split()[0] for f in MEASURE_FIELDS.split(", ")], dtype="object")

    return F.pandas_udf(run, MEASURE_FIELDS).asNondeterministic()(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def bands(measured: DataFrame, width: float = BAND_WIDTH) -> dict[str, dict[str, tuple[float, float]]]:
    """By group, the bounds of each measure, from the rows that pass the base rules.

    What reaches the driver is a count for each group and step of a measure: bounded by the steps
    of the measures' ranges and by the number of languages and scripts.
    """
    rows = measured.filter(~F.col("base_failed") & F.col("chars_per_token").isNotNull())
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.col(m) / step).cast("long").alias("at")) for m, (step, _) in MEASURES.items()])
    counts = rows.select("band", F.explode(pairs).alias("p")).groupBy("band", "p.m", "p.at").count().collect()
    by: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for r in counts:
        by.setdefault((r.band, r.m), []).append((r["at"], r["count"]))
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for (band, m), found in by.items():
        found.sort()
        step, slack = MEASURES[m]
        total = sum(n for _, n in found)
        quartile = []
        for q in (0.25, 0.75):
            passed = 0
            for at, n in found:
                passed += n
                if passed >= q * total:
                    quartile.append(at * step)
                    break
        reach = width * (quartile[1] - quartile[0]) + slack
        out.setdefault(band, {})[m] = (quartile[0] - reach, quartile[1] + step + reach)
    return out


def judge(docs: DataFrame, vocabularies: tuple[str, str] = VOCABULARIES, width: float = BAND_WIDTH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, then the measures of both vocabularies and the band's name.

    A null text has no words, like an empty one: it fails the base rules, and its measures are null.
    Repeated rows stay and count each time in the bands; a null doc_id is returned as null. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), measure_column(F.col(text_col), vocabularies).alias("m"))
    measured = rows.select("doc_id", "m.*", base_failed(F.col("m.n_words"), F.col("m.n_repeat_words")).alias("base_failed"), F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "m.script")).alias("band"))
    measured = settle(measured, "fertility")
    kept = ~F.col("base_failed") & inside(bands(measured, width))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select("doc_id", *base, "base_failed", kept.alias("kept"), "n_tokens", "seq_tokens", *MEASURES, "band")


def inside(limits: dict[str, dict[str, tuple[float, float]]]) -> Column:
    """Whether all measures of a row lie in the limits of its band; a band that no text has set rejects nothing."""
    found = F.lit(True)
    for m in MEASURES if limits else ():
        low, high = (F.create_map(*[F.lit(x) for b in sorted(limits) for x in (b, limits[b][m][k])])[F.col("band")] for k in (0, 1))
        found = found & F.coalesce((F.col(m) >= low) & (F.col(m) <= high), F.lit(True))
    return found
