"""Entry points: many files as DataFrames, one file as a record, presets by format."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quillmill.operators.chunks import OVERLAP, SIZE, check_window, chunk_documents
from quillmill.plans.normalise import normalise
from quillmill.plans.routing import ENGINES, check_options, rejects
from quillmill.sources import files as sources
from quillmill.sources import sinks


@dataclass
class Parsed:
    """Results of a batch. ``results`` holds every file that an engine took, with its raw output and its
    blocks or its ``error``; it is kept, so that the engines run once."""

    results: DataFrame
    rejected: DataFrame
    size: int
    overlap: int
    kept_at: str | None = None

    @property
    def raw(self) -> DataFrame:
        """doc_id, source, engine, raw, markdown, error, assets."""
        return self.results.drop("blocks")

    @cached_property
    def documents(self) -> DataFrame:
        """doc_id, source, engine, markdown, blocks (nested)."""
        return self.results.filter("error IS NULL").drop("raw", "assets", "error")

    @cached_property
    def blocks(self) -> DataFrame:
        each = self.documents.select("doc_id", "source", "engine", F.posexplode("blocks").alias("block_id", "b"))
        return each.select("doc_id", "source", "engine", F.col("block_id").cast("bigint").alias("block_id"), "b.*")

    @cached_property
    def chunks(self) -> DataFrame:
        return chunk_documents(self.documents.drop("markdown"), self.size, self.overlap)

    @property
    def nested(self) -> DataFrame:
        """Documents with raw, assets, blocks and chunks in one row."""
        fields = [c for c in self.chunks.columns if c not in {"chunk_id", "doc_id", "source", "engine"}]
        chunks = self.chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", *fields))).alias("chunks"))
        none = F.array().cast(chunks.schema["chunks"].dataType)
        return self.results.filter("error IS NULL").drop("error").join(chunks, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", none))

    def release(self) -> None:
        """Give up what is kept; the DataFrames can't be used afterwards."""
        self.results.unpersist()
        if self.kept_at:
            spark = self.results.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(self.kept_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _kept(results: DataFrame) -> tuple[DataFrame, str | None]:
    """results written to the folder that spark.checkpoint.dir names, where a lost executor costs nothing; without
    one (a local session), kept on the executors' disks from their first use on."""
    spark = results.sparkSession
    shared = _shared_folder(spark)
    if not shared:
        return results.persist(StorageLevel.DISK_ONLY), None
    path = f"{shared.rstrip('/')}/quillmill-parsed-{uuid.uuid4().hex}"
    results.write.parquet(path)
    return spark.read.schema(results.schema).parquet(path), path


def parse_documents(
    spark: SparkSession, paths: str | list[str], *, engine: str = "auto", chunk_size: int = SIZE, overlap: int = OVERLAP, strict: bool = True, profile: ResourceProfile | None = None, **engine_options
) -> Parsed:
    """Parse files or folders.

    Checks come in this order: listed files exist, window, engines, options. strict: a file that no
    engine takes, or that an engine or one of its gates fails on, is an error; otherwise such files are in
    ``rejected``, or have their ``error`` in ``raw``. profile: resources of the tasks that run the engines.
    """
    if isinstance(paths, list):
        sources.check_files(spark, paths)
    check_window(chunk_size, overlap)
    if engine != "auto" and engine not in ENGINES:
        raise ValueError(f"unsupported engine: {engine}")
    found = sources.scan(spark, paths, engine)
    refused = rejects(found.drop("content"), engine=engine)
    if strict and (bad := refused.select("path", "reason").head()):
        raise ValueError(f"{bad.path}: {bad.reason}")
    if engine_options:
        used = [r.engine for r in found.filter("engine IS NOT NULL").select("engine").distinct().collect()]
        check_options(used, engine_options)
    raw = sources.parse(found, engine_options, quarantine=not strict, profile=profile)
    results, path = _kept(normalise(raw, strict))
    return Parsed(results, refused, chunk_size, overlap, path)


@dataclass
class ParsedDocument:
    source: str
    engine: str
    output_dir: str
    markdown: str
    blocks: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)


def parse_document(file_path: str, *, engine: str = "auto", output_dir: str = "outputs", chunk_size: int = SIZE, overlap: int = OVERLAP, spark: SparkSession | None = None, **engine_options) -> ParsedDocument:
    """Parse one file, write its folder below output_dir, and return its record."""
    from pathlib import Path

    spark = spark or SparkSession.builder.getOrCreate()
    path = Path(file_path).resolve()
    if not path.is_file():
        raise FileNotFoundError(path)
    parsed = parse_documents(spark, [f"file://{path}"], engine=engine, chunk_size=chunk_size, overlap=overlap, **engine_options)
    try:
        folder = sinks.write_files(parsed, str(Path(output_dir).resolve())).head().folder
    finally:
        parsed.release()
    return ParsedDocument(**json.loads((Path(folder) / "document.json").read_text("utf-8")))


# Engine and options of each format's preset.
PRESETS: dict[str, tuple[str, dict]] = {
    "audio": ("qwen-asr", {"timestamps": True}),
    "pdf_text": ("mineru", {"tier": "standard"}),
    "pdf_scan": ("mineru", {"tier": "advanced"}),
    "pdf_mixed": ("mineru", {"tier": "advanced"}),
    "img": ("paddleocr", {}),
    "docx": ("docling", {}),
    "email": ("docling", {}),
    "html": ("docling", {}),
    "pptx": ("docling", {}),
    "xlsx": ("docling", {}),
}


def extract(preset: str, file_path: str, **options) -> ParsedDocument:
    """parse_document with a preset; given options win, the engine is fixed (naming one is a TypeError)."""
    engine, own = PRESETS[preset]
    return parse_document(file_path, engine=engine, **(own | options))


def extract_and_chunk(preset: str, file_path: str, **options) -> list[dict]:
    return extract(preset, file_path, **options).chunks


def preview(document: ParsedDocument, size: int = 2000, chunks: int = 3) -> tuple[str, list[dict]]:
    return document.markdown[:size], document.chunks[:chunks]
