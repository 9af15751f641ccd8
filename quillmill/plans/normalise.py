"""From an engine's raw JSON to ordered blocks of one schema.

Raw shapes (one JSON string a document):
mineru     {"pages": [{"page_idx", "blocks": [{"type", "content", ...}]}]}
paddleocr  [page, ...], each page {"res": page} or {"parsing_res_list": [{"block_label", "block_content", "block_bbox"}]}
docling    {"status", "items": [{"label", "text", "depth", "prov", "self_ref", "markdown", "caption"}]}
qwen-asr   {"timestamps": bool, "results": [{"text", "language", "time_stamps": [{"text", "start_time", "end_time"}]}]}

The first two are split in Python, because the engine's own block is kept as it was written; the
other two are native.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.binding import let
from quillmill.functions.text import content_of, strip
from quillmill.operators.segments import LIMIT_SECONDS, passages
from quillmill.schema import BLOCK_FIELDS, BLOCKS, WORD

LOST_PICTURE = "[Picture: see engine.json]"
_PAGED = "array<struct<kind:string,text:string,page:bigint,bbox:string,raw:string>>"


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _pdf_blocks(document: dict) -> list[dict]:
    out = []
    for page in document.get("pages", ()):
        number = page.get("page_idx")
        for block in page.get("blocks", ()):
            out.append(
                {
                    "kind": block.get("type", "unknown"),
                    "text": content_of(block["content"] if "content" in block else block),
                    "page": None if number is None else number + 1,
                    "bbox": None,
                    "raw": dump(block),
                }
            )
    return out


def _image_blocks(pages: list) -> list[dict]:
    out = []
    for number, page in enumerate(pages, 1):
        for block in page.get("res", page).get("parsing_res_list", ()):
            box = block.get("block_bbox")
            out.append({"kind": block.get("block_label", "unknown"), "text": content_of(block.get("block_content", "")), "page": number, "bbox": None if box is None else dump(box), "raw": dump(block)})
    return out


def paged_blocks(engine: Column, raw: Column) -> Column:
    """struct(blocks, error) of PDF and image engines; null for the others. An engine without a block is an error."""
    splitters = {"mineru": _pdf_blocks, "paddleocr": _image_blocks}

    def outcome(name: str, text: str) -> tuple[list[dict] | None, str | None]:
        try:
            blocks = splitters[name](json.loads(text))
        except (ValueError, TypeError, AttributeError) as e:
            return None, f"{name} returned another shape: {type(e).__name__}: {e}"
        return (blocks, None) if blocks else (None, f"{name} returned no blocks")

    def run(engines: pd.Series, documents: pd.Series) -> pd.DataFrame:
        found = [outcome(n, t) if n in splitters and t is not None else (None, None) for n, t in zip(engines, documents)]
        return pd.DataFrame({"blocks": pd.Series([b for b, _ in found], dtype="object"), "error": pd.Series([e for _, e in found], dtype="object")})

    return F.pandas_udf(run, f"blocks {_PAGED}, error string").asNondeterministic()(engine, raw)


_ITEMS = (
    "struct<status:string,items:array<struct<label:string,text:string,depth:bigint,prov:array<string>,"
    "self_ref:string,markdown:string,caption:string>>>"
)
_OFFICE_FIELDS = "kind,text,page,depth,provenance,reference"
_AUDIO_FIELDS = "kind,text,language,start,end,words"


def _office_text(item: Column) -> Column:
    caption = F.coalesce(F.nullif(item["caption"], F.lit("")), F.lit(LOST_PICTURE))
    return F.when(item["label"] == "table", item["markdown"]).when(item["label"] == "picture", caption).otherwise(item["text"])


def _office_block(item: Column) -> Column:
    provenance = F.coalesce(item["prov"], F.array().cast("array<string>"))
    return F.struct(
        item["label"].alias("kind"),
        _office_text(item).alias("text"),
        F.get_json_object(F.get(item["prov"], F.lit(0)), "$.page_no").cast("bigint").alias("page"),
        item["depth"].alias("depth"),
        F.concat(F.lit("["), F.array_join(provenance, ","), F.lit("]")).alias("provenance"),
        item["self_ref"].alias("reference"),
    )


def office_blocks(raw: Column) -> Column:
    """struct(blocks, error) of office engines: tables as Markdown, pictures by caption; items without text
    are never blocks. Any status but success is an error, partial success too."""

    def outcome(parsed: Column) -> Column:
        good = F.coalesce(parsed["status"], F.lit("")) == "success"
        named = F.filter(parsed["items"], lambda x: F.coalesce(_office_text(x), F.lit("")) != "")
        error = F.concat(F.lit("conversion status: "), F.coalesce(parsed["status"], F.lit("none")))
        return F.struct(F.when(good, F.transform(named, _office_block)).cast(blocks_type(_OFFICE_FIELDS)).alias("blocks"), F.when(~good, error).alias("error"))

    return let(F.from_json(raw, _ITEMS), outcome)


_STAMPS = "array<struct<text:string,start_time:double,end_time:double>>"
_RESULTS = f"struct<timestamps:boolean,results:array<struct<text:string,language:string,time_stamps:{_STAMPS}>>>"


def _words(result: Column) -> Column:
    return F.transform(
        F.coalesce(result["time_stamps"], F.array().cast(_STAMPS)),
        lambda w: F.struct(w["text"].alias("text"), w["start_time"].alias("start"), w["end_time"].alias("end")),
    )


def _untimed(result: Column) -> Column:
    nothing = F.lit(None)
    return F.array(
        F.struct(
            F.lit("transcript").alias("kind"), result["text"].alias("text"), result["language"].alias("language"),
            nothing.cast("double").alias("start"), nothing.cast("double").alias("end"), nothing.cast(f"array<{WORD}>").alias("words"),
        )
    )


def audio_outcome(raw: Column, limit: float = LIMIT_SECONDS) -> Column:
    """struct(blocks, error, markdown) of audio engines: passages of each result with word stamps, one block for a
    result without, groups never span results; Markdown of all transcripts. Stamps that were asked for and are
    missing from a result with text are an error. The document is parsed once, each result's words are made once."""

    def outcome(parsed: Column) -> Column:
        stamped = F.coalesce(parsed["timestamps"], F.lit(True))

        def blocks(result: Column) -> Column:
            return let(_words(result), lambda words: F.when(stamped & (F.size(words) > 0), passages(words, result["language"], limit)).otherwise(_untimed(result)))

        bare = F.exists(parsed["results"], lambda r: (F.size(F.coalesce(r["time_stamps"], F.array().cast(_STAMPS))) == 0) & (strip(F.coalesce(r["text"], F.lit(""))) != ""))
        error = F.when(parsed["results"].isNull(), F.lit("qwen-asr returned another shape")).when(stamped & bare, F.lit("word stamps were asked for and are missing"))
        return F.struct(
            F.flatten(F.transform(parsed["results"], blocks)).cast(blocks_type(_AUDIO_FIELDS)).alias("blocks"),
            error.alias("error"),
            F.array_join(F.transform(parsed["results"], lambda r: r["text"]), "\n\n").alias("markdown"),
        )

    return let(F.from_json(raw, _RESULTS), outcome)


def blocks_type(names: str) -> str:
    return f"array<struct<{','.join(f'{n}:{BLOCK_FIELDS[n]}' for n in names.split(','))}>>"


def _superset(blocks: Column, names: str) -> Column:
    own = set(names.split(","))
    return F.transform(blocks, lambda b: F.struct(*[(b[n] if n in own else F.lit(None)).cast(kind).alias(n) for n, kind in BLOCK_FIELDS.items()])).cast(BLOCKS)


def normalise(raw: DataFrame, strict: bool = True) -> DataFrame:
    """raw (doc_id, source, engine, raw, markdown, and error and assets if there) with ``blocks`` and ``error``; no row is shuffled.

    A document that fails a gate of its engine (no blocks, a status other than success, missing word
    stamps, raw output of another shape) is an error of the job if ``strict``; otherwise its row has
    null blocks and says why in ``error``. An error that raw brings stays and its row isn't parsed.
    Markdown of audio is made here, from the transcripts; the other engines bring theirs.
    """
    engine = F.col("engine")
    before = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    text = F.when(before.isNull(), F.col("raw"))
    kept = [c for c in ("assets",) if c in raw.columns]
    made = raw.select(
        "doc_id", "source", "engine", "raw", "markdown", before.alias("before"), *kept,
        paged_blocks(engine, text).alias("paged"),
        F.when(engine.isin("docling", "stdlib"), office_blocks(text)).alias("office"),
        F.when(engine == "qwen-asr", audio_outcome(text)).alias("audio"),
    )
    blocks = (
        F.when(engine.isin("mineru", "paddleocr"), _superset(F.col("paged.blocks"), "kind,text,page,bbox,raw"))
        .when(engine.isin("docling", "stdlib"), _superset(F.col("office.blocks"), _OFFICE_FIELDS))
        .when(engine == "qwen-asr", _superset(F.col("audio.blocks"), _AUDIO_FIELDS))
    )
    error = F.coalesce("before", "paged.error", F.when(F.col("raw").isNotNull(), F.coalesce("office.error", "audio.error")))
    if strict:
        failed = F.raise_error(F.concat(F.col("source"), F.lit(": "), error))
        blocks = F.when(error.isNull(), blocks).otherwise(failed.cast(BLOCKS))
    else:
        blocks = F.when(error.isNull(), blocks)
    markdown = F.when(engine == "qwen-asr", F.col("audio.markdown")).otherwise(F.col("markdown"))
    return made.select("doc_id", "source", "engine", "raw", markdown.alias("markdown"), blocks.alias("blocks"), error.alias("error"), *kept)
