"""Documents, blocks, chunks and raw output as tables or as one folder a document."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quillmill.functions.text import output_name
from quillmill.plans.routing import file_name
from quillmill.schema import ENGINE_FIELDS

CHUNK_POSITION = ["source", "block_id", "char_start", "char_end", "chunk_id"]


def to_json(value: Column) -> Column:
    """JSON that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def write_tables(parsed, path: str, mode: str = "errorifexists") -> None:
    """raw_engine, documents, blocks and chunks as Parquet below path, by engine; each table is committed at once."""
    for name in ("raw", "documents", "blocks", "chunks"):
        folder = "raw_engine" if name == "raw" else name
        getattr(parsed, name).write.mode(mode).partitionBy("engine").parquet(f"{path}/{folder}")


def assemble(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document with its ordered blocks and chunks, from the flat tables: one aggregation each and one join, on doc_id."""
    nest = lambda df, order, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in {order, "doc_id"}]))).alias(name))
    return nest(blocks, "block_id", "blocks").join(nest(chunks, "chunk_id", "chunks"), "doc_id", "full")


def _opened(block: dict, engine: str) -> dict:
    """A block with the keys of its engine, JSON fields parsed again."""
    timed = engine != "qwen-asr" or block.get("words") is not None
    names = [n for n in ENGINE_FIELDS[engine] if timed or n not in {"start", "end", "words"}]
    own = {n: block.get(n) for n in names}
    for n in ("raw", "provenance", "bbox"):
        if own.get(n) is not None:
            own[n] = json.loads(own[n])
    return own


def _files_of(r, folder: str) -> dict[str, bytes]:
    """Relative names and contents of a document's folder."""
    as_json = lambda value: json.dumps(value, ensure_ascii=False, indent=2).encode()
    blocks = [_opened(b, r.engine) for b in json.loads(r.blocks)]
    chunks = [_opened(c, r.engine) | {"text": c["text"], "source": r.source} | {k: c[k] for k in CHUNK_POSITION[1:]} for c in json.loads(r.chunks)]
    raw = json.loads(r.raw)
    if r.engine == "qwen-asr":
        raw = {"transcripts": [x["text"] for x in raw["results"]], "segments": blocks}
    elif r.engine == "docling":
        raw = raw.get("document", raw)
    document = {"source": r.source, "engine": r.engine, "output_dir": folder, "markdown": r.markdown, "blocks": blocks, "chunks": chunks}
    own = {asset["name"]: asset["content"] for asset in (r.assets if r.assets is not None else ())}
    return own | {"document.md": (r.markdown or "").encode(), "document.json": as_json(document), "chunks.json": as_json(chunks), "engine.json": as_json(raw)}


def _same(system, folder: str, files: dict[str, bytes]) -> bool:
    """Whether the folder holds these files with these bytes."""
    for name, content in files.items():
        if system.get_file_info(f"{folder}/{name}").type.name != "File":
            return False
        with system.open_input_stream(f"{folder}/{name}") as f:
            if f.read() != content:
                return False
    return True


def _put(system, root: str, name: str, files: dict[str, bytes]) -> None:
    """Fill a folder under another name and move it into place, or raise FileExistsError if another one is there."""
    folder, aside = f"{root}/{name}", f"{root}/_{name}-{uuid.uuid4().hex}"
    for path, content in files.items():
        system.create_dir(f"{aside}/{path}".rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{aside}/{path}") as f:
            f.write(content)
    try:
        if system.get_file_info(folder).type.name != "NotFound":
            raise FileExistsError(folder)
        system.move(aside, folder)
    except OSError:
        # an earlier attempt of this task, or an equal run, may have put the same folder there
        system.delete_dir(aside)
        if not _same(system, folder, files):
            raise FileExistsError(folder) from None


def write_files(parsed, out: str) -> DataFrame:
    """document.md, document.json, chunks.json, engine.json and the engine's own files in a folder for each document, below a
    path that the driver and all executors reach (a mounted one, or a URI that pyarrow opens: hdfs, s3, gs, abfs); returns doc_id and folder.

    A folder is filled under another name and then moved, so a failed task leaves no half document and a
    repeated one finds its own. A folder with other content is an error. For as many documents as one file
    system is to list; write_tables has no such bound. The result is kept on the executors, not on the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _system(out)
        for batch in batches:
            for r in batch.itertuples(index=False):
                _put(system, root, r.folder, _files_of(r, f"{out.rstrip('/')}/{r.folder}"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "folder": out.rstrip("/") + "/" + batch["folder"]})

    nested = parsed.nested
    folder = output_name(file_name(F.col("source")), F.col("doc_id"))
    flat = nested.select("doc_id", "source", "engine", "raw", "markdown", "assets", to_json(F.col("blocks")).alias("blocks"), to_json(F.col("chunks")).alias("chunks"), folder.alias("folder"))
    done = flat.mapInPandas(run, "doc_id string, folder string").persist(StorageLevel.DISK_ONLY)
    done.count()
    return done


def _system(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else os.path.abspath(path))
