"""SentencePiece encoding and decoding with exact N-best segmentation.

Method. The piece lattice of a text has an edge for each piece of a public vocabulary, and, for a
character without a piece of its own, an edge of fallback bytes. A forward Viterbi pass gives each
position the score of its best prefix. A backward A-star search from the end then extends partial
segmentations to the left; a partial one's priority is its own score plus the forward score where it
ends, which is exact, so complete segmentations leave the queue in order of score and no step is wasted.

Pieces of such vocabularies never reach over a word's leading space run or over a line break, so the
lattice of a text is a chain of small lattices, and its N-best list is found exactly without one
search over the whole text: each segment's Viterbi pass also yields the gap to its second-best
reading, only the N segments with the smallest gaps can differ from their best reading in an N-best
list, and those few are searched by A-star and combined. Segments are kept in a bounded memo.

The Viterbi passes of all segments that are new in a run of texts are made together: edges are found by
rolling hashes of 1, 2, ... characters, as long as they begin a piece, and the passes advance over
all segments one position at a time. Segments of over ``LONG`` characters have a pass of their own.

Scores are those in the vocabulary file. A character without a piece scores ``FALLBACK`` below
the worst piece. Equal scores: within a segment the one whose search branched last comes first; in a
text the readings are compared from the last segment to the first, lower ranks first.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from array import array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import HashTable

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
FALLBACK = 10.0
SPACE = "▁"
LONG = 64
_MEMO = 200_000
#: Texts whose new segments are taken together.
_RUN = 100
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEGMENT = re.compile(" *[^ \n]+| +|\n")

FIELDS = "n_pieces long, n_byte_pieces long, best_score double, nbest array<struct<score: double, n_pieces: long, ids_hash: string>>, round_trip boolean"


class Pieces:
    """A vocabulary as a prefix table: piece or beginning of a piece -> id, or -1."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.score = [model.get_score(i) for i in range(len(self.text))]
        self.byte = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.steps: dict[str, int] = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                for k in range(1, len(piece)):
                    self.steps.setdefault(piece[:k], -1)
                self.steps[piece] = i
        normal = [self.score[i] for i in self.steps.values() if i >= 0 and self.text[i].strip(SPACE)]
        self.fallback = min(normal) - FALLBACK
        self.longest = max(map(len, self.steps))
        hashes = np.array([self._hash(x) for x in self.steps], np.uint64).view(np.int64)
        order = np.argsort(hashes)
        self.table = HashTable(hashes[order])
        self.piece_of = np.array(list(self.steps.values()), np.int64)[order]
        self.scores = np.array([*self.score, self.fallback])  # the last is that of id -1
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[list(self.byte_of)] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def lattice(self, segment: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Edges (start, id, score) by their end, id -1 for fallback bytes; forward Viterbi scores."""
        n, steps, score = len(segment), self.steps, self.score
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        forward = [float("-inf")] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            j = i + 1
            piece = steps.get(segment[i:j])
            if piece is None or piece < 0:
                into[j].append((i, -1, self.fallback))
                if here + self.fallback > forward[j]:
                    forward[j] = here + self.fallback
            while piece is not None:
                if piece >= 0:
                    s = score[piece]
                    into[j].append((i, piece, s))
                    if here + s > forward[j]:
                        forward[j] = here + s
                if j == n:
                    break
                j += 1
                piece = steps.get(segment[i:j])
        return into, forward

    def ids_of(self, segment: str, edges: list[tuple[int, int, int]]) -> list[int]:
        """Edges (start, end, id) in order to ids."""
        out: list[int] = []
        for a, b, piece in edges:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte[x] for x in segment[a:b].encode("utf-8", "surrogatepass"))
        return out

    def best(self, segment: str) -> tuple[float, list[int], float]:
        """Score and ids of the Viterbi reading, and how far the second-best lies below it."""
        into, forward = self.lattice(segment)
        edges, gap, j = [], float("inf"), len(segment)
        while j:
            chosen = None
            for edge in into[j]:
                behind = forward[j] - forward[edge[0]] - edge[2]
                if chosen is None and behind == 0:
                    chosen = edge
                elif behind < gap:
                    gap = behind
            edges.append((chosen[0], j, chosen[1]))
            j = chosen[0]
        return forward[-1], self.ids_of(segment, edges[::-1]), gap

    def best_of(self, segments: list[str]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
        """best() of many segments at once: scores, ids, gaps."""
        count = len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, count)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(count), sizes)
        left = np.repeat(first + sizes, sizes) - np.arange(len(codes))
        # a segment of n characters has n + 1 nodes; the node before character i of segment s is i + s
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, lengths, pieces = [], [], []
        for size in range(1, self.longest + 1):
            inside = left[alive] >= size
            alive, h = alive[inside], h[inside]
            h = h * _BASE + codes[alive + size - 1]
            at = self.table.find(h.view(np.int64))
            piece = np.where(at >= 0, self.piece_of[at], -1)
            if size == 1:
                starts.append(alive), lengths.append(np.ones(len(alive), np.int64)), pieces.append(piece)
            else:
                real = piece >= 0
                starts.append(alive[real]), lengths.append(np.full(int(real.sum()), size)), pieces.append(piece[real])
            alive, h = alive[at >= 0], h[at >= 0]
            if not len(alive):
                break
        start, length, piece = map(np.concatenate, (starts, lengths, pieces))
        end_at = start - first[owner[start]] + length
        tail = start + owner[start]
        head = tail + length
        nodes = len(codes) + count
        # by position in the segment, then by node, then the longest piece first
        order = np.argsort((end_at * nodes + head) * 64 + (63 - length))
        tail, head, piece, end_at = tail[order], head[order], piece[order], end_at[order]
        score = self.scores[piece]
        forward, gap, chosen = np.zeros(nodes), np.full(nodes, np.inf), np.zeros(nodes, np.int64)
        turns = np.flatnonzero(np.concatenate(([True], end_at[1:] != end_at[:-1], [True])))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
            value, to = forward[tail[a:b]] + score[a:b], head[a:b]
            opens = np.concatenate(([True], to[1:] != to[:-1]))
            at = np.flatnonzero(opens)
            best = np.maximum.reduceat(value, at)
            same = value == best[np.cumsum(opens) - 1]
            winner = np.minimum.reduceat(np.where(same, np.arange(b - a), b), at)
            value[winner] = -np.inf
            forward[to[at]], chosen[to[at]] = best, winner + a
            gap[to[at]] = best - np.maximum.reduceat(value, at)
        ends = first + sizes + np.arange(count)
        node, who = ends.copy(), np.arange(count)
        least = np.full(count, np.inf)
        taken, whose, turn = [], [], 0
        while len(who):
            least[who] = np.minimum(least[who], gap[node])
            edge = chosen[node]
            taken.append(edge), whose.append(who)
            node = tail[edge]
            on = node != first[who] + who
            node, who, turn = node[on], who[on], turn + 1
        edge, who = np.concatenate(taken)[::-1], np.concatenate(whose)[::-1]
        order = np.argsort(who, kind="stable")
        edge, who = edge[order], who[order]
        found = piece[edge]
        number = np.bincount(who, minlength=count)
        cuts = np.cumsum(number)
        plain = found.tolist()
        ids = [plain[a:b] for a, b in zip((cuts - number).tolist(), cuts.tolist())]
        for s in np.unique(who[found < 0]).tolist():
            own = slice(int(cuts[s] - number[s]), int(cuts[s]))
            base = first[s] + s
            ids[s] = self.ids_of(segments[s], list(zip((tail[edge[own]] - base).tolist(), (head[edge[own]] - base).tolist(), found[own].tolist())))
        return forward[ends], ids, least

    def nbest(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best readings by backward A-star; the first is the Viterbi reading."""
        into, forward = self.lattice(segment)
        queue = [(-forward[-1], 0, len(segment), 0.0, None)]
        pushed, out = 0, []
        while queue and len(out) < n:
            _, _, j, own, chain = heapq.heappop(queue)
            if not j:
                edges = []
                while chain:
                    edges.append(chain[0])
                    chain = chain[1]
                out.append((own, self.ids_of(segment, edges)))
                continue
            # of equal priorities the last pushed leaves first: the edge that Viterbi takes
            for i, piece, s in reversed(into[j]):
                pushed += 1
                heapq.heappush(queue, (-(own + s + forward[i]), -pushed, i, own + s, ((i, j, piece), chain)))
        return out

    def decode(self, ids) -> str:
        """Text of ids that stand inside a text: the space sign becomes a space, bytes are joined."""
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


class Segmenter:
    """N-best segmentations of whole texts, with a bounded memo of segments."""

    def __init__(self, path: str = VOCABULARY):
        self.pieces = Pieces(path)
        self.memo: dict[str, tuple] = {}
        self.searched: dict[tuple[str, int], list] = {}

    def learn(self, segments: set[str]) -> None:
        """Best readings of the segments that the memo lacks: score, packed ids, number of ids, of byte ids, gap, decoded text."""
        memo, pieces = self.memo, self.pieces
        new = [x for x in segments if x not in memo]
        short = [x for x in new if len(x) <= LONG]
        found = [(x, *pieces.best(x.replace(" ", SPACE))) for x in new if len(x) > LONG]
        if short:
            scores, ids, gaps = pieces.best_of("\0".join(short).replace(" ", SPACE).split("\0") if not any("\0" in x for x in short) else [x.replace(" ", SPACE) for x in short])
            found += zip(short, scores.tolist(), ids, gaps.tolist())
        text, byte_of = pieces.text.__getitem__, pieces.byte_of.keys()
        for x, score, ids, gap in found:
            plain = byte_of.isdisjoint(ids)
            decoded = "".join(map(text, ids)).replace(SPACE, " ") if plain else pieces.decode(ids)
            memo[x] = score, array("i", ids).tobytes(), len(ids), 0 if plain else sum(i in byte_of for i in ids), gap, decoded

    def ready(self, texts: list[str | None]) -> list[list[str]]:
        """Learn the segments of several texts together; the segments of each."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        parts = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        return parts

    def segments(self, text: str) -> tuple[list[str], list[tuple]]:
        (parts,) = self.ready([text])
        return parts, list(zip(*map(self.memo.__getitem__, parts)))

    def encode(self, text: str) -> list[int]:
        return self.nbest(text, 1)[0][1].tolist()

    def decode(self, ids) -> str:
        """Inverse of encode: the space put before a text is taken off again."""
        text = self.pieces.decode(ids)
        return text[1:] if text.startswith(" ") else text

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[float, array]]:
        """Scores and ids of the n best readings of a whole text, best first."""
        if not text:
            return [(0.0, array("i"))]
        return [(s, array("i", b)) for s, b in self._nbest(*self.segments(text), n)]

    def _nbest(self, parts: list[str], held: list[tuple], n: int) -> list[tuple[float, bytes]]:
        """parts with their memo entries, field by field"""
        scores, packed, _, _, gaps, _ = held
        best = sum(scores)
        if n == 1:
            return [(best, b"".join(packed))]
        gap = np.array(gaps)
        near = np.flatnonzero(gap <= (np.partition(gap, n - 1)[n - 1] if len(gap) > n else np.inf))
        near = near[np.argsort(gap[near], kind="stable")][:n].tolist()
        options = {}
        if len(self.searched) > 20_000:
            self.searched.clear()
        for k in sorted(k for k in near if gaps[k] != float("inf")):
            key = (parts[k], n)
            if key not in self.searched:
                self.searched[key] = [(s, array("i", ids).tobytes()) for s, ids in self.pieces.nbest(parts[k].replace(" ", SPACE), n)]
            options[k] = self.searched[key]
        # (loss, ranks of the readings from the last segment to the first)
        lists: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for found in options.values():
            lists = sorted((loss + found[0][0] - s, (r, *ranks)) for loss, ranks in lists for r, (s, _) in enumerate(found))[:n]
        out = []
        for loss, ranks in lists:
            own = list(packed)
            for k, r in zip(options, reversed(ranks)):
                if r:
                    own[k] = options[k][r][1]
            out.append((best - loss, b"".join(own)))
        return out

    def describe(self, text: str | None, n: int = N_BEST, parts: list[str] | None = None) -> tuple:
        """The values of FIELDS; parts: what ready() has given for the text."""
        if text is None:
            return 0, 0, None, [], None
        if not text:
            return 0, 0, 0.0, [(0.0, 0, xxhash.xxh64_hexdigest(b""))], True
        if parts is None:
            (parts,) = self.ready([text])
        held = list(zip(*map(self.memo.__getitem__, parts)))
        found = self._nbest(parts, held, n)
        same = "".join(held[5]) == " " + text
        lists = [(s, len(b) // 4, xxhash.xxh64_hexdigest(b)) for s, b in found]
        return lists[0][1], sum(held[3]), lists[0][0], lists, same


_held: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    return _held.get(path) or _held.setdefault(path, Segmenter(path))


def segment_column(text: Column, n: int = N_BEST, vocabulary: str = VOCABULARY) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = segmenter(vocabulary)
        for batch in texts:
            texts, rows = batch.tolist(), []
            for a in range(0, len(texts), _RUN):
                run = texts[a : a + _RUN]
                rows += [own.describe(t, n, parts) for t, parts in zip(run, own.ready(run))]
            yield pd.DataFrame(
                {
                    "n_pieces": pd.Series([r[0] for r in rows], dtype="int64"),
                    "n_byte_pieces": pd.Series([r[1] for r in rows], dtype="int64"),
                    "best_score": pd.Series([r[2] for r in rows], dtype="float64"),
                    "nbest": pd.Series([[{"score": s, "n_pieces": k, "ids_hash": h} for s, k, h in r[3]] for r in rows], dtype="object"),
                    "round_trip": pd.Series([r[4] for r in rows], dtype="object"),
                }
            )

    return F.pandas_udf(run, FIELDS).asNondeterministic()(text)


def encode_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of the best reading; null for a null text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = segmenter(vocabulary)
        for batch in texts:
            yield pd.Series([None if t is None else own.encode(t) for t in batch], dtype="object")

    return F.pandas_udf(run, "array<int>").asNondeterministic()(text)


def decode_column(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Text of ids; null for null."""

    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = segmenter(vocabulary)
        for batch in lists:
            yield pd.Series([None if x is None else own.decode(list(x)) for x in batch], dtype="object")

    return F.pandas_udf(run, "string").asNondeterministic()(ids)


def segment(docs: DataFrame, n: int = N_BEST, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, n_byte_pieces, best_score, nbest, round_trip.

    nbest lists score, number of pieces and hash (XXH64 of the ids as little-endian int32) of up to n
    readings, best first. A null text has no pieces, a null score, an empty list and a null round_trip; an
    empty text has one reading without pieces. Repeated rows and null ids stay. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("doc_id"), segment_column(F.col(text_col), n, vocabulary).alias("s")).select("doc_id", "s.*")
