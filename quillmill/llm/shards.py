"""Immutable Parquet shards with size-tiered compaction and versioned manifests.

Method. Arrivals are appended as small shards, files that are never changed. A manifest is a JSON
file ``manifest/v00000001.json`` that lists the live shards; it is written aside and renamed to its
version's name, and the rename fails if the version exists, so one of two writers wins and readers
see whole versions only. Compaction groups live shards by size tier (powers of ``ratio``); the lowest
tier with at least ``min_runs`` shards is merged into files of about ``target_bytes``, and the new manifest swaps
inputs for outputs at once. A shard is rewritten about log_ratio(target / smallest) times. Spark
packs the inputs of a merge into read partitions of the target size, and each partition writes one
file: nothing is shuffled, no task holds more than a target file. A merge whose outputs don't
hold as many rows as its inputs isn't committed. What a lost job leaves behind is in no manifest; ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import free_names, scratch_path

TARGET_BYTES = 128 << 20
BASE_BYTES = 1 << 20
RATIO = 4
MIN_RUNS = 4
ARRIVALS = 8
#: Size of row groups: what a writer or a reader of a shard holds at once.
ROW_GROUP_BYTES = 32 << 20


#: Versions that vacuum leaves readable, the last one included.
KEEP = 3


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _file_of(stored: DataFrame) -> Column:
    """Folder and name of the file that a row is read from."""
    return F.regexp_extract(stored.metadataColumn("_metadata")["file_path"], r"([^/]+/[^/]+)$", 1)


class ManifestConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, ratio: int = RATIO, min_runs: int = MIN_RUNS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.base_bytes, self.ratio, self.min_runs = target_bytes, base_bytes, ratio, min_runs
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _files(self, folder: str) -> list[dict]:
        """Parquet files below a folder: path below the root, bytes."""
        if not self._fs.exists(self._path(folder)):
            return []
        found, todo = [], [self._path(folder)]
        top = self._fs.makeQualified(self._path(self.root)).toUri().getPath().rstrip("/") + "/"
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append({"file": s.getPath().toUri().getPath().removeprefix(top), "bytes": s.getLen()})
        return sorted(found, key=lambda f: f["file"])

    def _read_files(self, shards: list[dict], schema: T.StructType, session: SparkSession | None = None) -> DataFrame:
        session = session or self.spark
        if not shards:
            return session.createDataFrame([], schema)
        return session.read.schema(schema).parquet(*[f"{self.root}/{s['file']}" for s in shards])

    def _counted(self, files: list[dict], schema: T.StructType) -> list[dict]:
        """Adds the number of rows of each file; files without a row are left out."""
        if not files:
            return []
        stored = self._read_files(files, schema)
        rows = {r.name: r.n for r in stored.groupBy(_file_of(stored).alias("name")).agg(F.count("*").alias("n")).collect()}
        tail = lambda f: "/".join(f["file"].split("/")[-2:])
        return [f | {"rows": rows[tail(f)]} for f in files if tail(f) in rows]

    # manifests

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, based_on: int, schema: T.StructType, shards: list[dict]) -> int:
        """Publish version based_on + 1, or raise ManifestConflict if it is there already."""
        version = based_on + 1
        body = json.dumps({"version": version, "schema": schema.json(), "shards": shards}).encode()
        aside = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(body)
        stream.close()
        final = self._path(f"{self.root}/manifest/v{version:08d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        keep_old = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(final), keep_old)
        except Exception as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise ManifestConflict(f"version {version} exists") from e
            raise
        return version

    # operations

    def append(self, df: DataFrame) -> int:
        """Write df as new shards and commit them; the new version."""
        return self.append_arrivals(df, None)[-1]

    def append_arrivals(self, df: DataFrame, arrival=None, commit: bool = True) -> list:
        """Write df once and append it arrival by arrival (a column; nulls last): one version, or one list of shards if not commit, each."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        (lot,) = free_names(df.columns, "arrival")
        writer = df.withColumn(lot, F.lit(0) if arrival is None else arrival).write.partitionBy(lot)
        writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
        files = self._counted(self._files(folder), df.schema)
        batches: dict[str, list[dict]] = {}
        for f in files:
            batches.setdefault(f["file"].split("/")[-2].removeprefix(f"{lot}="), []).append(f)
        order = sorted(batches, key=lambda k: (k == "__HIVE_DEFAULT_PARTITION__", int(k) if k.lstrip("-").isdigit() else 0, k))
        groups = [batches[k] for k in order] or [[]]
        return [self.add(df.schema, g) for g in groups] if commit else groups

    def add(self, schema: T.StructType, shards: list[dict]) -> int:
        """Commit written shards; tries again behind other writers."""
        while True:
            now = self.manifest()
            if now["schema"] and T.StructType.fromJson(json.loads(now["schema"])).simpleString() != schema.simpleString():
                raise ValueError("the store holds another schema")
            try:
                return self.commit(now["version"], schema, now["shards"] + shards)
            except ManifestConflict:
                continue

    def tier(self, size: int) -> int:
        return int(math.log(max(1.0, size / self.base_bytes), self.ratio))

    def plan(self, shards: list[dict]) -> list[dict]:
        """Shards of the lowest tier that is due; none that has reached three quarters of the target."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < 0.75 * self.target_bytes:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        due = [t for t, own in sorted(tiers.items()) if len(own) >= self.min_runs]
        return tiers[due[0]] if due else []

    def compact(self) -> int:
        """Merge tiers until none is due; the version reached."""
        skip: set[str] = set()
        while True:
            now = self.manifest()
            runs = self.plan([s for s in now["shards"] if s["file"] not in skip])
            if not runs:
                return now["version"]
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            session = self.spark.newSession()
            # whole files are packed into read partitions of the target size, none is split
            session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            session.conf.set("spark.sql.files.minPartitionNum", "1")
            self._read_files(runs, schema, session).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/merged")
            merged = self._counted(self._files(folder), schema)
            if sum(s["rows"] for s in merged) != sum(s["rows"] for s in runs):
                raise RuntimeError("a merge has lost or repeated rows; nothing was committed")
            gone = {s["file"] for s in runs}
            try:
                self.commit(now["version"], schema, [s for s in now["shards"] if s["file"] not in gone] + merged)
            except ManifestConflict:
                continue
            if len(merged) >= len(runs):  # packing could not join any
                skip |= {s["file"] for s in merged}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store is empty")
        return self._read_files(now["shards"], T.StructType.fromJson(json.loads(now["schema"])))

    def read_with_shards(self, version: int | None = None) -> DataFrame:
        """All rows of a version with two columns behind their own: the number of the shard in the manifest, and the version.

        They are called __shard and __version, with underscores put before them where a column has that name
        already. The numbers are broadcast: two values a shard, of which the driver holds the list anyway. Rows aren't shuffled.
        """
        now = self.manifest(version)
        rows = self.read(version)
        tail, shard, number = free_names(rows.columns, "__tail", "__shard", "__version")
        tails = ["/".join(s["file"].split("/")[-2:]) for s in now["shards"]]
        places = self.spark.createDataFrame(list(zip(tails, range(len(tails)))), T.StructType().add(tail, "string").add(shard, "long"))
        placed = rows.withColumn(tail, _file_of(rows)).join(F.broadcast(places), tail, "left")
        return placed.select(*[_quoted(c) for c in (*rows.columns, shard)], F.lit(now["version"]).cast("long").alias(number))

    def vacuum(self, keep: int = KEEP, pending: list[dict] = ()) -> int:
        """Delete data files that neither the last ``keep`` versions nor ``pending`` (written, not yet committed) name; how many.

        Not to be run beside another writer: what that has written and not committed would go.
        """
        now = self.version()
        live = {s["file"] for v in range(max(1, now - keep + 1), now + 1) for s in self.manifest(v)["shards"]} | {s["file"] for s in pending}
        gone = [f for f in self._files(f"{self.root}/data") if f["file"] not in live]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{f['file']}"), False)
        return len(gone)


def ingest(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, compact_every: int = 4, id_col: str = "doc_id", keep: int = KEEP, **options) -> ShardStore:
    """Append docs in ``arrivals`` lots, by a hash of the id, and compact after every few lots.

    The store holds docs with all columns and rows as they are, nulls, repeated rows and any column names
    included; an empty table gives a version without shards. The last ``keep`` versions stay readable, for
    readers that hold one. Without a root the store is scratch: it lies in the shared folder, in a local session only until its end.
    """
    store = ShardStore(docs.sparkSession, root or scratch_path(docs.sparkSession, "shards"), **options)
    lot = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(arrivals))
    lots = store.append_arrivals(docs, lot, commit=False)
    for k, shards in enumerate(lots):
        store.add(docs.schema, shards)
        if (k + 1) % compact_every == 0:
            store.compact()
            store.vacuum(keep, pending=[s for later in lots[k + 1 :] for s in later])
    store.compact()
    store.vacuum(keep)
    return store
