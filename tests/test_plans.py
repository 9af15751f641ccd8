import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.segments import passages
from quillmill.plans import normalise, routing
from quillmill.schema import WORD


def test_suffixes(spark):
    expected = {
        "a.pdf": ".pdf", "a.tar.gz": ".gz", ".pdf": "", "a.": "", "a": "", "A.B.PDF": ".pdf", "..x": ".x", "a..b": ".b", "dir.d": ".d", "x. y": ". y", "a\nb.txt": ".txt",
    }
    got = spark.createDataFrame([(n,) for n in expected], "n string").select("n", routing.suffix(F.col("n")).alias("s"), T.stem(F.col("n")).alias("stem")).collect()
    assert {r.n: r.s for r in got} == expected
    assert {r.n: r.stem for r in got}["a.tar.gz"] == "a.tar" and {r.n: r.stem for r in got}[".pdf"] == ".pdf"


def test_routes_and_rejects(spark):
    names = [f"/in/f{s.upper() if i % 2 else s}" for i, s in enumerate(x for own in routing.SUFFIXES.values() for x in own)]
    assert len(names) == 22
    df = spark.createDataFrame([(n,) for n in [*names, "/in/x.doc", "/in.pdf/none"]], "path string")
    name = routing.file_name(F.col("path"))
    got = {r.path: r.e for r in df.select("path", routing.choose_engine(name).alias("e")).collect()}
    assert sum(v is not None for v in got.values()) == 22 and got["/in/x.doc"] is None
    assert {r.path for r in routing.rejects(df).collect()} == {"/in/x.doc", "/in.pdf/none"}
    assert {r[0] for r in df.select(routing.choose_engine(name, "mineru")).collect()} == {"mineru"}
    assert {r[0] for r in df.select(routing.choose_engine(name, "other")).collect()} == {None}


def test_options():
    routing.check_options(["mineru"], {"tier": "advanced"})
    with pytest.raises(TypeError):
        routing.check_options(["docling"], {"tier": "standard"})
    with pytest.raises(ValueError):
        routing.check_options(["mineru"], {"tier": "best"})


def test_content():
    assert T.content_of({"html": "h", "text": None}) == ""
    assert T.content_of(["a", None, ["b", {"latex": 1e20}]]) == "a\n\nb\n1e+20"
    assert T.content_of({"é": [1.10, True]}) == '{"é": [1.1, true]}'
    assert [T.content_of(v) for v in ("s", None, True, 1e-05, 7)] == ["s", "", "True", "1e-05", "7"]


def raw(spark, engine, *documents):
    return spark.createDataFrame([(str(i), "s", engine, json.dumps(d, ensure_ascii=False), "md") for i, d in enumerate(documents)], "doc_id string, source string, engine string, raw string, markdown string")


def blocks(df):
    return {int(r.doc_id): [b.asDict() for b in r.blocks] for r in normalise.normalise(df).collect()}


def test_pdf_pages(spark):
    odd = {"content": None, "x": [1.50]}
    got = blocks(raw(spark, "mineru", {"pages": [{"page_idx": 0, "blocks": [{"type": "table", "content": {"table_body": "<t>"}}, {"k": 1}]}, {"blocks": [odd, {"type": None, "content": "x"}]}, {}]}))[0]
    assert [(b["kind"], b["text"], b["page"]) for b in got] == [("table", "<t>", 1), ("unknown", '{"k": 1}', 1), ("unknown", "", None), (None, "x", None)]
    assert json.loads(got[2]["raw"]) == odd
    with pytest.raises(PySparkException):
        blocks(raw(spark, "mineru", {"pages": []}))
    with pytest.raises(PySparkException):
        blocks(raw(spark, "mineru", {}))


def test_image_pages(spark):
    page = {"parsing_res_list": [{"block_label": "text", "block_content": "a", "block_bbox": [1, 2.5]}, {}]}
    got = blocks(raw(spark, "paddleocr", [{"res": page}, page]))[0]
    assert [(b["kind"], b["text"], b["page"], b["bbox"]) for b in got] == [("text", "a", 1, "[1, 2.5]"), ("unknown", "", 1, None), ("text", "a", 2, "[1, 2.5]"), ("unknown", "", 2, None)]
    with pytest.raises(PySparkException):
        blocks(raw(spark, "paddleocr", []))


def test_office_items(spark):
    items = [
        {"label": "text", "text": "a", "depth": 1, "prov": [{"page_no": 4, "bbox": {"l": 1}}], "self_ref": "#/texts/0"}, {"label": "text", "text": "", "prov": []}, {"label": "text", "text": " ", "prov": []},
        {"label": "table", "text": "", "markdown": "| t |", "prov": []}, {"label": "picture", "caption": ""}, {"label": "picture", "caption": "c"},
    ]
    got = blocks(raw(spark, "docling", {"status": "success", "items": items}, {"status": "success", "items": []}))
    assert [(b["kind"], b["text"], b["page"]) for b in got[0]] == [("text", "a", 4), ("text", " ", None), ("table", "| t |", None), ("picture", normalise.LOST_PICTURE, None), ("picture", "c", None)]
    assert got[0][0]["reference"] == "#/texts/0" and json.loads(got[0][0]["provenance"]) == [{"page_no": 4, "bbox": {"l": 1}}] and got[1] == []
    with pytest.raises(PySparkException):
        blocks(raw(spark, "docling", {"status": "partial_success", "items": items}))


def word(text, a, b):
    return {"text": text, "start_time": a, "end_time": b}


def test_transcripts(spark):
    results = [
        {"text": "a b c", "language": "en", "time_stamps": [word("a", 0.0, 1.0), word("b", 29.0, 30.0), word("c", 29.5, 30.1)]},
        {"text": "long d", "language": "fr", "time_stamps": [word("long", 100.0, 140.0), word("d", 140.0, 139.0)]},
        {"text": " ", "language": "de", "time_stamps": []},
    ]
    got = blocks(raw(spark, "qwen-asr", {"timestamps": True, "results": results}))[0]
    assert [(b["text"], b["start"], b["end"], b["language"]) for b in got] == [("a b", 0.0, 30.0, "en"), ("c", 29.5, 30.1, "en"), ("long", 100.0, 140.0, "fr"), ("d", 140.0, 139.0, "fr"), (" ", None, None, "de")]
    df = raw(spark, "qwen-asr", {"timestamps": False, "results": [{"text": "x", "language": "en"}, {"text": "y", "language": "en"}]})
    assert [b["text"] for b in blocks(df)[0]] == ["x", "y"] and normalise.normalise(df).head().markdown == "x\n\ny"
    with pytest.raises(PySparkException):
        blocks(raw(spark, "qwen-asr", {"timestamps": True, "results": [{"text": "x", "language": "en", "time_stamps": []}]}))


def test_passages_match_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for d in range(120):
        t, words = 0.0, []
        for i in range(rng.randrange(0, 40)):
            length = rng.choice([0.0, 0.5, 4.0, 31.0])
            words.append((str(i), t, t + length))
            t += length + rng.choice([0.0, 1.0, 10.0])
        rows.append((d, words))
    got = spark.createDataFrame(rows, f"d long, w array<{WORD}>").select("d", passages(F.col("w"), F.lit("x")).alias("p")).collect()
    for r in got:
        groups = []
        for w in rows[r.d][1]:
            if not groups or w[2] - groups[-1][0][1] > 30:
                groups.append([])
            groups[-1].append(w)
        assert [[tuple(w) for w in p.words] for p in r.p or []] == groups
        assert all((p.start, p.end) == (g[0][1], g[-1][2]) for p, g in zip(r.p or [], groups))
