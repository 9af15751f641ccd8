"""Character windows over blocks.

A block of n stripped characters has, in closed form, m = max(1, ceil((n - overlap) / (size - overlap)))
windows, window k starting at k * (size - overlap). So chunks come from one projection and one
generate; nothing is looped and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions.text import is_atomic, strip

SIZE, OVERLAP = 1200, 150


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"a window of {size} with an overlap of {overlap}: the size must be positive and the overlap at least 0 and below the size")


def window_count(n: Column, size: int, overlap: int, atomic: Column) -> Column:
    cut = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(size - overlap)))
    return F.when(n == 0, 0).when(atomic, 1).otherwise(cut).cast("int")


def stripped(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def windows(body: Column, n: Column, kind: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<char_start, char_end, text>> of a block, given its stripped text and that one's length; empty for a blank one.

    They should be plain columns or fields: each window looks at them, so an expression in their place would run as often.
    """
    check_window(size, overlap)
    atomic = is_atomic(kind)
    count = window_count(n, size, overlap, atomic)

    def window(k: Column) -> Column:
        start = k * (size - overlap)
        end = F.when(atomic, n).otherwise(F.least(n, start + size))
        return F.struct(start.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"), F.substring(body, start + 1, end - start).alias("text"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(F.array().cast("array<struct<char_start:bigint,char_end:bigint,text:string>>"))


def chunk_texts(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text_col: str = "text", kind: Column | None = None) -> DataFrame:
    """Chunks of a table in which a row is a document of one block: all columns, the text replaced, and block_id, chunk_id, char_start, char_end."""
    others = [c for c in docs.columns if c not in {text_col, "block_id", "chunk_id", "char_start", "char_end"}]
    kind = F.lit(None).cast("string") if kind is None else kind
    bodies = docs.select(*others, kind.alias("__kind"), stripped(F.col(text_col)).alias("__body"))
    bodies = bodies.withColumn("__n", F.length("__body"))
    each = bodies.select(*others, F.posexplode(windows(F.col("__body"), F.col("__n"), F.col("__kind"), size, overlap)).alias("chunk_id", "w"))
    return each.select(*others, F.lit(0).cast("bigint").alias("block_id"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "w.char_start", "w.char_end", F.col("w.text").alias(text_col))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, blocks_col: str = "blocks") -> DataFrame:
    """Chunks of a table in which a row is a document with an ordered array of blocks (structs with kind and text).

    Each chunk has the document's other columns, its block's fields with the text replaced, the block's
    position block_id (blank blocks count, so there may be gaps), char_start, char_end, and chunk_id, dense in the document.
    """
    check_window(size, overlap)
    fields = [f.name for f in docs.schema[blocks_col].dataType.elementType.fields if f.name != "text"]
    others = [c for c in docs.columns if c != blocks_col]
    bodies = docs.withColumn("__bodies", F.transform(blocks_col, lambda b: F.struct(stripped(b["text"]).alias("body"), b["kind"].alias("kind"))))
    bodies = bodies.withColumn("__bodies", F.transform("__bodies", lambda b: F.struct(b["body"].alias("body"), F.length(b["body"]).alias("n"), b["kind"].alias("kind"))))
    cut = F.transform("__bodies", lambda b, i: F.transform(windows(b["body"], b["n"], b["kind"], size, overlap), lambda w: F.struct(i.cast("bigint").alias("block_id"), w.alias("w"))))
    each = bodies.select(*others, blocks_col, F.posexplode(F.flatten(cut)).alias("chunk_id", "c"))
    block = F.get(blocks_col, F.col("c.block_id").cast("int"))
    return each.select(
        *others, F.col("c.block_id").alias("block_id"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("c.w.char_start").alias("char_start"), F.col("c.w.char_end").alias("char_end"),
        F.col("c.w.text").alias("text"), *[block[f].alias(f) for f in fields],
    )


def chunk_blocks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_col: str = "doc_id") -> DataFrame:
    """Chunks of a flat table of blocks (doc_col, block_id, kind, text, ...): one shuffle, of blocks and not of chunks, numbers them."""
    check_window(size, overlap)
    blocks = blocks.withColumn("text", stripped(F.col("text"))).withColumn("__n", F.length("text"))
    count = window_count(F.col("__n"), size, overlap, is_atomic(F.col("kind")))
    before = W.partitionBy(doc_col).orderBy("block_id").rowsBetween(W.unboundedPreceding, -1)
    numbered = blocks.withColumn("__first", F.coalesce(F.sum(count.cast("bigint")).over(before), F.lit(0).cast("bigint")))
    others = [c for c in blocks.columns if c not in {"text", "chunk_id", "char_start", "char_end", "__n"}]
    each = numbered.select(*others, "__first", F.posexplode(windows(F.col("text"), F.col("__n"), F.col("kind"), size, overlap)).alias("__k", "w"))
    return each.select(*others, (F.col("__first") + F.col("__k")).alias("chunk_id"), "w.char_start", "w.char_end", "w.text")
