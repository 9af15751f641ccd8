"""A folder of arriving files as a stream of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.chunks import OVERLAP, SIZE, chunk_documents
from quillmill.plans.normalise import normalise
from quillmill.sources.files import parse, routed

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_chunks(spark: SparkSession, folder: str, *, engine: str = "auto", chunk_size: int = SIZE, overlap: int = OVERLAP, **engine_options) -> DataFrame:
    """Chunks of files as they arrive. It keeps no state, so no watermark is needed; files without an engine are left out, and files on which
    an engine or one of its gates fails stay out (see stream_documents for the reasons)."""
    documents = stream_documents(spark, folder, engine=engine, **engine_options).filter("error IS NULL")
    return chunk_documents(documents.drop("markdown", "error"), chunk_size, overlap)


def stream_documents(spark: SparkSession, folder: str, *, engine: str = "auto", **engine_options) -> DataFrame:
    """doc_id, source, engine, markdown, blocks and error of files as they arrive; a failing file is a row with its error and no blocks."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)
    raw = parse(routed(files, engine), engine_options, quarantine=True).drop("assets")
    return normalise(raw, strict=False).drop("raw")


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet sink with exactly-once commits; takes what has arrived and ends."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("engine").trigger(availableNow=True).start()
