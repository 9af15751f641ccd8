"""SimHash near-duplicate groups through forests of BK-trees.

Method. Every text gets a 64-bit SimHash. Equal fingerprints are folded first, so a group of exact
copies costs one node however large it is. Two fingerprints that differ in at most ``radius`` bits
agree on at least one of ``radius + 1`` equal bit blocks, so (block number, block value) is a shard
that loses no link. Each shard holds a BK-tree: a child hangs below its parent under the integer
Hamming distance between the two, and a search for radius r from a node at distance d follows only
the edges d - r .. d + r. A task takes its shards in order, some hundred thousand rows at a time, and
builds and searches their trees level by level with numpy. A shard with more than ``shard_limit``
fingerprints is dealt anew by equal blocks of the bits it doesn't share yet, which again loses no link,
and so on until none is larger, or until the bits left allow no more than some ten thousand values. Tasks report the links as stars (fingerprint, smallest
linked fingerprint of the shard), never as all pairs; the stars are joined to components by
min-label rounds with pointer jumping on Spark, each round settled in the shared folder.

The trees are not broadcast: a broadcast passes through the driver, and the trees hold the fingerprints of
all documents, so no bound can be given for it. They are shuffled by shard instead, and each query meets
exactly the trees that can hold a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import free_names, measured_broadcast, settle, unsettle

SEED = 42
SHINGLE = 3
RADIUS = 3
BITS = 64
#: Fingerprints of one shard beyond which it is dealt by blocks of its other bits.
SHARD_LIMIT = 20_000
#: Times that a shard is dealt: with a radius of 3 the last ones share 48 bits or more, so they hold 2 ** 16 values at most.
LEVELS = 5
#: Rows of whole shards that a task searches together, and rows of a shuffle partition.
SEARCH_ROWS = 200_000
PARTITION_ROWS = 4_000_000
#: (query, node) pairs that a search holds at once.
FRONTIER = 2_000_000

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; zero for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n
    )
    lanes = hashes.view(np.uint8).reshape(n, 8)
    if n < 512:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        values = np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch))
        yield pd.Series(values.view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The SimHash as a signed bigint with the same 64 bits."""
    return F.pandas_udf(_fingerprints, "long").asNondeterministic()(text)


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Forest:
    """BK-trees over many shards at once. ``values`` must be sorted by shard; equal values may occur."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values
        self.root = np.zeros(n, np.int64)
        heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        self.root[:] = np.repeat(heads, np.diff(np.append(heads, n)))
        items = np.setdiff1d(np.arange(n), heads, assume_unique=True)
        parent = self.root[items]
        edge, child = [], []
        while len(items):
            # the edge's key: parent and integer distance; the first item of a key becomes the child node
            key = parent * (BITS + 1) + np.bitwise_count(values[items] ^ values[parent])
            order = np.argsort(key, kind="stable")
            items, key = items[order], key[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            nodes = items[first]
            edge.append(key[first])
            child.append(nodes)
            parent = nodes[np.cumsum(first) - 1][~first]
            items = items[~first]
        edges = np.concatenate(edge) if edge else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edge = edges[order]
        self.child = (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query, node) positions, node < query, at a distance of at most radius."""
        n = len(self.values)
        todo = [(np.arange(a, min(a + FRONTIER // 4, n)), None) for a in range(0, n, FRONTIER // 4)]
        while todo:
            query, node = todo.pop()
            node = self.root[query] if node is None else node
            while len(query):
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (distance <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                base = node * (BITS + 1)
                low = np.searchsorted(self.edge, base + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.edge, base + np.minimum(distance + radius, BITS), side="right")
                width = high - low
                on = width > 0
                query, low, width = query[on], low[on], width[on]
                total = int(width.sum())
                if total > FRONTIER and len(query) > 1:
                    half = len(query) // 2
                    for part in (slice(0, half), slice(half, None)):
                        todo.append(self._step(query[part], low[part], width[part]))
                    break
                query, node = self._step(query, low, width)

    def _step(self, query: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offset = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        return np.repeat(query, width), self.child[np.repeat(low, width) + offset]


def local_components(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each of n positions."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _search(shard: np.ndarray, signed: np.ndarray, radius: int) -> pa.RecordBatch:
    """Stars of whole shards; both arrays are sorted by shard."""
    # a fingerprint alone in its shard has no neighbour there
    same = shard[1:] == shard[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    shard, signed = shard[keep], signed[keep]
    # in the order of fp, so that a star's root is the smallest one
    order = np.lexsort((signed, shard))
    shard, signed = shard[order], signed[order]
    label = local_components(len(signed), Forest(signed.view(np.uint64), shard).links(radius))
    tail = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.stack([signed[tail], signed[label[tail]]], axis=1), axis=0) if len(tail) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["fp", "root"])


def _stars(radius: int):
    """Rows (shard, fp) sorted by shard to stars. Whole shards are taken together until there are ``SEARCH_ROWS`` rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = signed = np.zeros(0, np.int64)
        for batch in batches:
            shard, signed = np.concatenate((shard, batch.column(0).to_numpy())), np.concatenate((signed, batch.column(1).to_numpy()))
            if len(shard) >= SEARCH_ROWS:
                whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if whole:
                    yield _search(shard[:whole], signed[:whole], radius)
                    shard, signed = shard[whole:], signed[whole:]
        if len(shard):
            yield _search(shard, signed, radius)

    return run


def _split(mask: int, parts: int) -> list[int]:
    """mask with, in turn, each of ``parts`` equal blocks of the bits outside it; none if a block would be empty."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    if 0 in np.diff(cuts):
        return []
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - 2**BITS if mask >> (BITS - 1) else mask


def star_links(prints: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """prints: one row per distinct fp, settled. Returns (fp, root) links whose closure joins all within radius.

    A shard is a mask of bits and their value. Within a shard, two fingerprints that differ in at most
    radius bits agree on one of radius + 1 blocks of the other bits, so dealing it anew loses no link.
    """
    masks, depth = _split(0, radius + 1), 1
    level = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    while True:
        dealt = level.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        finer = {m: _split(m, radius + 1) for m in masks} if depth < LEVELS else {}
        if not all(finer.values()) or not finer:
            found.append(dealt)
            break
        hot = dealt.groupBy("mask", "value").count().filter((F.col("count") > shard_limit)).select("mask", "value", F.lit(True).alias("hot"))
        hot = settle(hot, "simhash-hot")
        # only the masks of hot shards go on, a bounded number of them
        far = [r.mask % 2**BITS for r in hot.select("mask").distinct().collect()]
        if not far:
            found.append(dealt)
            break
        finer = {m: finer[m] for m in far}
        marked = dealt.join(measured_broadcast(hot), ["mask", "value"], "left")
        found.append(marked.filter("hot IS NULL").select("fp", "mask", "value"))
        children = F.create_map(*[x for m, own in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in own]))])
        level = marked.filter("hot").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        masks, depth = sorted({c for own in finer.values() for c in own}), depth + 1
    rows = reduce(DataFrame.unionAll, found).select(F.xxhash64("mask", "value").alias("shard"), "fp")
    parts = -(-(radius + 1) * prints.count() // PARTITION_ROWS)
    wide = parts > int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = (rows.repartition(parts, "shard") if wide else rows.repartition("shard")).sortWithinPartitions("shard")
    return keyed.mapInArrow(_stars(radius), "fp long, root long").distinct()


def components(links: DataFrame, label: str = "simhash") -> DataFrame:
    """(fp, root) links to (fp, component): the smallest fp reachable, for every linked fp.

    Each round takes the smallest label among a node's neighbours, then jumps to that label's own
    label, so a chain of length d needs about log d rounds. Hot roots meet only min() aggregates,
    which combine before the shuffle, and joins that AQE may split.
    """
    both = settle(links.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(links.select(F.col("root"), F.col("fp"))), f"{label}-links")
    state = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("n"), "l", F.col("a").alias("old")), f"{label}-labels")
    while True:
        now = state.select("n", "l")
        seen = both.join(now, both.b == now.n).groupBy("a").agg(F.min("l").alias("near"))
        near = now.join(seen, now.n == seen.a, "left").select("n", F.col("l").alias("old"), F.least("l", F.coalesce("near", "l")).alias("l"))
        target = now.select(F.col("n").alias("t"), F.col("l").alias("tl"))
        after = settle(near.join(target, near.l == target.t, "left").select("n", F.least("l", F.coalesce("tl", "l")).alias("l"), "old"), f"{label}-labels")
        unsettle(state)
        state = after
        if not state.filter(F.col("l") != F.col("old")).limit(1).count():
            unsettle(both)
            return state.select(F.col("n").alias("fp"), F.col("l").alias("component"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (bigint), fingerprint (hex), component_id.

    component_id is the smallest doc_id that can be reached over links of at most ``radius`` bits.
    A null or word-less text has fingerprint zero and links like any other. Repeated rows stay; a
    null doc_id keeps its row and is never a component_id unless nothing else is reachable (then
    null). Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    base = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "simhash-prints")
    named = group_fingerprints(base, radius, shard_limit)
    return named.select("doc_id", "fp", hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def group_fingerprints(base: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Rows (doc_id, fp bigint) with component_id, as in near_duplicate_groups()."""
    prints = settle(base.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    joined = components(star_links(prints.select("fp"), radius, shard_limit))
    grouped = prints.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.select("fp", "component").join(first, "component").select("fp", "component_id")
    return base.join(named, "fp")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which none in their near-duplicate group comes before them; all columns of docs, whatever their names.

    A group's rows are ordered by id (null last), then by fingerprint; of rows equal in both, which are in
    one group, one stays. Rows are told apart by id and fingerprint, not by id alone: if an id is repeated
    with texts of different groups, each group decides for itself and loses none to the other. Null ids are
    no exception. A null or word-less text has fingerprint zero. An empty table gives an empty result.

    The verdict is made on ids and fingerprints alone, one row for each fingerprint that shares a group; it is
    joined to the rows by a broadcast up to a measured size, so that texts are shuffled only beyond it.
    """
    columns = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    (fp,) = free_names(docs.columns, "fp")
    marked = settle(docs.withColumn(fp, fingerprint_column(F.col(text_col))), "simhash-rows")
    verdict = _verdict(marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp")), radius, shard_limit)
    of, stays, head, repeated = free_names(marked.columns, *verdict.columns)
    verdict = measured_broadcast(verdict).toDF(of, stays, head, repeated)
    known = marked.join(verdict, F.col(fp) == F.col(of), "left").filter(F.col(stays).isNull() | (F.col(stays) & F.col(id_col).eqNullSafe(F.col(head))))
    if not verdict.filter(repeated).limit(1).count():
        return known.select(*columns)
    once = known.filter(repeated).groupBy(id_col, fp).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row")).select("row.*")
    return known.filter(~F.coalesce(repeated, F.lit(False))).select(*columns).unionAll(once)


def _verdict(rows: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """rows (doc_id, fp) to (fp, stays, head, repeated) of each fingerprint in a group of several rows: whether rows with it
    stay, with which id (null safe), and whether several rows have both. Settled."""
    pairs = rows.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first")
    prints = settle(pairs.groupBy("fp").agg(first, F.sum("n").alias("rows")), "simhash-distinct")
    joined = components(star_links(prints.select("fp"), radius, shard_limit))
    grouped = prints.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    order = F.struct("first.none", "first.doc_id", "fp", "first.n")
    heads = grouped.groupBy("component").agg(F.min(order).alias("head"), F.sum("rows").alias("rows")).filter("rows > 1").select("component", "head")
    stays = F.col("fp") == F.col("head.fp")
    verdict = grouped.join(heads, "component").select("fp", stays.alias("stays"), F.when(stays, F.col("head.doc_id")).alias("head"), (stays & (F.col("head.n") > 1)).alias("repeated"))
    return settle(verdict, "simhash-verdict")
