"""Shared plumbing of the training-data operators: table access and shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SEPARATORS = " \t\n\x0b\x0c\r"

_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one if unset in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="quillmill-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return _own_scratch[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/quillmill-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to shared storage and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def unsettle(*settled: DataFrame) -> None:
    """Delete what settle() has written for frames that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores put before it as tell it apart from all others, whatever their case."""
    used, found = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


#: Rows of one long column that may be broadcast: about 100 MB as a hash relation.
BROADCAST_ROWS = 1_000_000


def measured_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows; otherwise as it is, for a join that shuffles. df must be settled."""
    return F.broadcast(df) if df.count() <= most else df


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_share(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone; used to draw bounded, repeatable samples. Null with a null among them."""
    parts = [c.cast("string") for c in columns]
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    share = F.xxhash64(F.lit("sample"), *parts).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(2**32))
    return F.when(known, share)


class HashTable:
    """Open-addressing lookup from int64 keys to positions in a sorted key array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, (len(keys) * 2).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = self.slot[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slot[at[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for a key that isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._hash(keys)
        held = self.slot[at]
        # an empty slot's -1 compares with the last key and is told apart by its sign
        hit = (self.keys[held] == keys) & (held >= 0)
        out = np.where(hit, held, -1)
        open_ = np.flatnonzero(~hit & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slot[at[open_]]
            hit = (self.keys[held] == keys[open_]) & (held >= 0)
            out[open_[hit]] = held[hit]
            open_ = open_[~hit & (held >= 0)]
        return out
