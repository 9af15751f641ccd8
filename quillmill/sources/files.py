"""Files to raw engine output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.routing import choose_engine, file_name
from quillmill.sources.adapters import ADAPTERS

RAW = "doc_id string, source string, engine string, raw string, markdown string, error string, assets array<struct<name:string,content:binary>>"


def check_files(spark: SparkSession, paths: list[str]) -> None:
    """FileNotFoundError unless every path is a file, ValueError for one without a byte (a scan would leave it out); asked of the file system that the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not (fs.exists(at) and fs.getFileStatus(at).isFile()):
            raise FileNotFoundError(path)
        if not fs.getFileStatus(at).getLen():
            raise ValueError(f"{path}: empty file")


def scan(spark: SparkSession, paths: str | list[str], engine: str = "auto") -> DataFrame:
    """path, name, doc_id, engine (null if none takes the file) and content; unselected content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return routed(files, engine)


def routed(files: DataFrame, engine: str = "auto") -> DataFrame:
    name = file_name(F.col("path"))
    identity = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.select("path", name.alias("name"), F.sha2(identity, 256).alias("doc_id"), choose_engine(name, engine).alias("engine"), "content")


def gpu_profile(gpus: float = 1, cores: int = 1) -> ResourceProfile:
    """Resources of a task that runs an engine on a GPU; the cluster manager must support stage-level scheduling."""
    needs = TaskResourceRequests().cpus(cores).resource("gpu", gpus)
    return ResourceProfileBuilder().require(needs).build


def parse(files: DataFrame, options: dict | None = None, quarantine: bool = False, profile: ResourceProfile | None = None) -> DataFrame:
    """RAW rows of routed files. An adapter is built once a partition and engine, and its failure fails the job unless quarantine is set.

    profile: resources of the tasks that run the engines, and of no others.
    """
    options = options or {}
    builders: dict[str, Callable] = dict(ADAPTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Callable] = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    if r.engine not in ready:
                        ready[r.engine] = builders[r.engine](**options)
                    raw, markdown, *written = ready[r.engine](bytes(r.content), r.name)
                    assets = [{"name": name, "content": data} for name, data in (written[0] if written else ())]
                    rows.append((r.doc_id, r.path, r.engine, raw, markdown, None, assets))
                except Exception as e:
                    if not quarantine:
                        raise
                    rows.append((r.doc_id, r.path, r.engine, None, None, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "engine", "raw", "markdown", "error", "assets"], dtype="object")

    return files.filter(F.col("engine").isNotNull()).select("doc_id", "path", "name", "engine", "content").mapInPandas(run, RAW, profile=profile)


def read_table(spark: SparkSession, path: str | list[str], suffix: str = ".csv", header: bool = True) -> DataFrame:
    """A CSV or TSV file as a table of strings: BOM dropped, quoted line breaks and doubled quotes kept."""
    return spark.read.csv(path, sep="\t" if suffix.lower() == ".tsv" else ",", multiLine=True, escape='"', header=header)
