import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.functions import text as T
from quillmill.operators import chunks
from pyspark.sql import functions as F


def plain_windows(text, kind, size, overlap):
    """Offsets by walking along the text."""
    body = text.strip()
    if any(w in (kind or "") for w in ("table", "equation", "formula")):
        return [(0, len(body), body)] if body else []
    out, a = [], 0
    while a < len(body):
        b = min(a + size, len(body))
        out.append((a, b, body[a:b]))
        a = b - overlap if b < len(body) else len(body)
    return out


CASES = ["", " 　\x1c", "a", "x" * 9, "x" * 10, "x" * 11, "  " + "yz" * 40 + "\n", "é日\U0001f600" * 21, "\x85tail"]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 9), (10, 3), (1, 0)])
def test_windows(spark, size, overlap):
    rows = [(i, t, k) for i, (t, k) in enumerate((t, k) for t in CASES for k in (None, "text", "Table", "table_caption", "formula"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: [tuple(w) for w in r.w] for r in df.withColumn("text", chunks.stripped(F.col("text"))).select("doc_id", chunks.windows(F.col("text"), F.length("text"), F.col("kind"), size, overlap).alias("w")).collect()}
    assert got == {i: plain_windows(t, k, size, overlap) for i, t, k in rows}


@settings(max_examples=300, deadline=None)
@given(n=st.integers(0, 300), size=st.integers(1, 60), data=st.data())
def test_closed_form(n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    expected = plain_windows("x" * n, "", size, overlap)
    count = 0 if n == 0 else max(1, -(-(n - overlap) // (size - overlap)))
    assert len(expected) == count
    assert [a for a, _, _ in expected] == [k * (size - overlap) for k in range(count)]


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (5, 5), (5, -1), (5, 6)])
def test_window_parameters(spark, size, overlap):
    with pytest.raises(ValueError):
        chunks.chunk_texts(spark.range(1).select(F.lit("x").alias("text")), size, overlap)


def test_numbering_of_nested_and_flat_blocks(spark):
    rng = random.Random(4)
    docs = [(d, [(rng.choice(["text", "table", None]), rng.choice(["", "  ", "abc", "q" * 37, "z" * 64])) for _ in range(rng.randrange(0, 7))]) for d in range(30)]
    nested = spark.createDataFrame(docs, "doc_id long, blocks array<struct<kind:string,text:string>>")
    expected = []
    for d, blocks in docs:
        each = [(b, w, k) for b, (k, t) in enumerate(blocks) for w in plain_windows(t, k, 16, 5)]
        expected += [(d, b, n, *w, k) for n, (b, w, k) in enumerate(each)]
    columns = ["doc_id", "block_id", "chunk_id", "char_start", "char_end", "text", "kind"]
    assert sorted(map(tuple, chunks.chunk_documents(nested, 16, 5).select(*columns).collect()), key=repr) == sorted(expected, key=repr)
    flat = nested.select("doc_id", F.posexplode("blocks").alias("block_id", "b")).select("doc_id", F.col("block_id").cast("long").alias("block_id"), "b.*")
    assert sorted(map(tuple, chunks.chunk_blocks(flat, 16, 5).select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_chunking_doesnt_shuffle(spark):
    nested = spark.createDataFrame([(1, [("text", "abc")])], "doc_id long, blocks array<struct<kind:string,text:string>>")
    plan = chunks.chunk_documents(nested)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_strip_is_unicode(spark):
    samples = [f"{c}x {c}y{c}{c}" for c in T.WHITESPACE] + ["​x​", "᠎x", ""]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select(T.strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [s.strip() for s in samples]
