import json
import zipfile

import pytest
from pyspark.errors import PySparkException

import quillmill
from quillmill import api
from quillmill.sources import adapters, files, parsers, sinks
from quillmill.streaming.files import stream_chunks, stream_documents, write_chunks

HTML = """<!DOCTYPE html><html><head><title>A title</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><!-- no -->
<h1>Head</h1><p>One &amp; <b>two</b></p><ul><li>first</li><li>second</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>1</td></tr></table><img src="x" alt="seen"><footer>End</footer></body></html>"""
MAIL = "Subject: =?utf-8?b?UsOpc3Vtw6k=?=\r\nFrom: a@example.com\r\nTo: b@example.com\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\nHello é\r\n\r\n- x\r\n- y\r\n\r\n--\r\nThe sender\r\n\r\n> old\r\n> words\r\n"


def office(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "page.html").write_text(HTML)
    (tmp_path / "mail.EML").write_bytes(MAIL.encode())
    (tmp_path / "t.csv").write_bytes('﻿Item,Note\r\nA,"two\nlines"\r\n'.encode())
    (tmp_path / "t.tsv").write_bytes('﻿Item\tNote\nB\t"say ""hi"""\n'.encode())
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    office(tmp_path / "d.docx", {"word/document.xml": f'<w:document {w}><w:body>{p("Top", "Title")}{p("Part", "Heading1")}{p("Words")}<w:tbl><w:tr><w:tc>{p("c1")}</w:tc><w:tc>{p("c2")}</w:tc></w:tr></w:tbl></w:body></w:document>'})
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="urn:p"'
    slide = lambda t: f'<p:sld {a}><p:sp><p:ph type="title"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    office(tmp_path / "s.pptx", {f"ppt/slides/slide{n}.xml": slide(f"Slide {n}") for n in (10, 2)})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office(
        tmp_path / "b.xlsx",
        {
            "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>',
        },
    )
    return tmp_path


def test_offline_formats(spark, folder):
    parsed = quillmill.parse_documents(spark, str(folder), engine="stdlib", chunk_size=20, overlap=5)
    by: dict = {}
    for r in parsed.blocks.orderBy("source", "block_id").collect():
        by.setdefault(r.source.rsplit("/", 1)[1], []).append((r.kind, r.text, r.page))
    assert by["page.html"][:4] == [("title", "A title", None), ("nav", "Home", None), ("section_header", "Head", None), ("text", "One & two", None)]
    assert by["page.html"][4:] == [("list_item", "first", None), ("list_item", "second", None), ("table", "| k | v |\n| --- | --- |\n| a\\|b | 1 |", None), ("picture", "seen", None), ("footer", "End", None)]
    assert [k for k, _, _ in by["mail.EML"]] == ["title", "text", "text", "text", "text", "signature", "quote"] and by["mail.EML"][0][1] == "Résumé"
    assert by["t.csv"] == [("table", "| Item | Note |\n| --- | --- |\n| A | two lines |", None)]
    assert by["t.tsv"] == [("table", '| Item | Note |\n| --- | --- |\n| B | say "hi" |', None)]
    assert [k for k, _, _ in by["d.docx"]] == ["title", "section_header", "text", "table"]
    assert by["s.pptx"] == [("title", "Slide 2", 1), ("title", "Slide 10", 2)]
    assert by["b.xlsx"] == [("table", "| name |  | 3 |\n| --- | --- | --- |", 1)]
    chunks = parsed.chunks.collect()
    assert all(len(c.text) <= 20 or c.kind == "table" for c in chunks)
    assert parsed.rejected.count() == 0 and parsed.documents.count() == 7
    parsed.release()


def test_table_source_and_tsv(spark, folder):
    rows = files.read_table(spark, str(folder / "t.tsv"), ".TSV").collect()
    assert [tuple(r) for r in rows] == [("B", 'say "hi"')] and rows[0].__fields__ == ["Item", "Note"]
    assert parsers.tsv_to_csv(b'\xef\xbb\xbfa\t"b,c"\n') == b'a,"b,c"\r\n'


def test_checks_in_order(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        quillmill.parse_documents(spark, [str(folder / "none.html")], chunk_size=0)
    with pytest.raises(FileNotFoundError):
        quillmill.parse_documents(spark, [str(folder)])
    with pytest.raises(ValueError):
        quillmill.parse_documents(spark, [str(folder / "t.csv")], chunk_size=0, engine="x")
    with pytest.raises(ValueError):
        quillmill.parse_documents(spark, [str(folder / "t.csv")], engine="x")
    with pytest.raises(TypeError):
        quillmill.parse_documents(spark, [str(folder / "t.csv")], tier="standard")
    (folder / "x.doc").write_bytes(b"x")
    with pytest.raises(ValueError):
        quillmill.parse_documents(spark, str(folder))
    (folder / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "void.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        quillmill.parse_documents(spark, [str(tmp_path / "void.csv")])
    adapters.register("docling", adapters.stdlib_engine)
    try:
        parsed = quillmill.parse_documents(spark, str(folder), strict=False)
        assert [r.path.rsplit("/", 1)[1] for r in parsed.rejected.collect()] == ["x.doc"]
        errors = {r.source.rsplit("/", 1)[1]: r.error for r in parsed.raw.collect() if r.error}
        assert set(errors) == {"x.pdf"} and errors["x.pdf"].startswith("ModuleNotFoundError")
        parsed.release()
    finally:
        adapters.register("docling", adapters.office_engine)
    with pytest.raises(PySparkException):
        quillmill.parse_documents(spark, [str(folder / "x.pdf")]).raw.count()
    with pytest.raises(PySparkException):  # the office engine isn't installed, and no other one takes its place
        quillmill.parse_documents(spark, [str(folder / "t.csv")]).raw.count()


GOOD = {"mineru": {"pages": [{"blocks": [{"content": "good"}]}]}, "paddleocr": [{"parsing_res_list": [{"block_content": "good"}]}], "docling": {"status": "success", "items": [{"label": "text", "text": "good"}]}, "qwen-asr": {"timestamps": True, "results": [{"text": "good", "time_stamps": [{"text": "good", "start_time": 0.0, "end_time": 1.0}]}]}}
FAILING = {"mineru": {"pages": []}, "paddleocr": [{"parsing_res_list": []}], "docling": {"status": "partial_success", "items": []}, "qwen-asr": {"timestamps": True, "results": [{"text": "bare", "time_stamps": []}]}}
REASONS = {"mineru": "no blocks", "paddleocr": "no blocks", "docling": "partial_success", "qwen-asr": "word stamps"}
NAMES = {"mineru": "pdf", "paddleocr": "png", "docling": "html", "qwen-asr": "wav"}


@pytest.fixture
def canned(tmp_path):
    """A good file of each engine, one that fails at the engine's gate, and one whose raw output isn't JSON."""
    before = dict(adapters.ADAPTERS)
    for engine, suffix in NAMES.items():
        documents = {"good": json.dumps(GOOD[engine]), "gate": json.dumps(FAILING[engine]), "junk": "{not json"}
        for kind in documents:
            (tmp_path / f"{kind}.{suffix}").write_bytes(b"x")
        adapters.register(engine, lambda documents=documents, **_: lambda data, name: (documents[name.split(".")[0]], None))
    yield tmp_path
    adapters.ADAPTERS.update(before)


def test_gates_are_quarantined(spark, canned):
    parsed = quillmill.parse_documents(spark, str(canned), strict=False)
    errors = {r.source.rsplit("/", 1)[1]: r.error for r in parsed.raw.collect()}
    for engine, suffix in NAMES.items():
        assert errors[f"good.{suffix}"] is None and REASONS[engine] in errors[f"gate.{suffix}"] and errors[f"junk.{suffix}"]
    assert [(b.text, b.source.rsplit("/", 1)[1].split(".")[0]) for b in parsed.blocks.collect()] == [("good", "good")] * 4
    assert parsed.chunks.count() == 4 and parsed.documents.count() == 4 and parsed.nested.count() == 4
    parsed.release()
    for suffix in NAMES.values():
        for kind in ("gate", "junk"):
            with pytest.raises(PySparkException):
                quillmill.parse_documents(spark, [str(canned / f"{kind}.{suffix}")]).blocks.collect()


def test_a_stream_outlives_failing_files(spark, canned, tmp_path):
    chunks = stream_chunks(spark, str(canned))
    write_chunks(chunks, str(tmp_path / "sink"), str(tmp_path / "check")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == ["good"] * 4
    documents = stream_documents(spark, str(canned)).select("source", "error").writeStream.format("parquet").option("path", str(tmp_path / "all")).option("checkpointLocation", str(tmp_path / "c2"))
    documents.trigger(availableNow=True).start().awaitTermination()
    assert {r.source.rsplit("/", 1)[1].split(".")[0] for r in spark.read.parquet(str(tmp_path / "all")).filter("error IS NOT NULL").collect()} == {"gate", "junk"}


def test_results_are_written_where_the_cluster_says(spark, canned, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "_shared_folder", lambda spark: f"file://{tmp_path}/shared")
    parsed = quillmill.parse_documents(spark, [str(canned / "good.pdf")])
    assert parsed.kept_at.startswith(f"file://{tmp_path}/shared/") and parsed.chunks.count() == 1
    parsed.release()
    assert not any((tmp_path / "shared").glob("quillmill*"))


def test_office_adapter_follows_the_engine(monkeypatch):
    """The installed engine's interface, by a stand-in module of the same shape."""
    import sys
    from enum import Enum
    from types import ModuleType, SimpleNamespace

    class Label(Enum):
        TABLE = "table"
        PICTURE = "picture"

    class Converter:
        def convert(self, path):
            read = open(path).read()
            prov = [SimpleNamespace(model_dump=lambda mode: {"page_no": 2})]
            items = [
                (SimpleNamespace(label="text", text=read, self_ref="#/texts/0", prov=prov), 1),
                (SimpleNamespace(label=Label.TABLE, self_ref="#/tables/0", export_to_markdown=lambda doc: "| t |"), 2),
                (SimpleNamespace(label=Label.PICTURE, text="", self_ref="#/pictures/0", prov=[], caption_text=lambda doc: ""), 1),
            ]
            document = SimpleNamespace(iterate_items=lambda: iter(items), export_to_dict=lambda: {"whole": True}, export_to_markdown=lambda: "md")
            return SimpleNamespace(status=SimpleNamespace(value="failure" if "bad" in path else "success"), errors=["why"], document=document)

    module = ModuleType("docling.document_converter")
    module.DocumentConverter = Converter
    monkeypatch.setitem(sys.modules, "docling", ModuleType("docling"))
    monkeypatch.setitem(sys.modules, "docling.document_converter", module)
    parse = adapters.office_engine()
    raw, markdown, assets = parse(b"a\t\"b,c\"\n", "x.TSV")
    got = json.loads(raw)
    assert markdown == "md" and got["document"] == {"whole": True} and [n for n, _ in assets] == ["converted-input.csv"]
    assert got["items"][0] | {} == {"label": "text", "text": 'a,"b,c"\n', "depth": 1, "self_ref": "#/texts/0", "prov": [{"page_no": 2}]}
    assert got["items"][1]["label"] == "table" and got["items"][1]["markdown"] == "| t |" and got["items"][2]["caption"] == ""
    with pytest.raises(RuntimeError, match="failure"):
        parse(b"x", "bad.html")


def test_single_file_and_presets(spark, folder, tmp_path):
    got = quillmill.parse_document(str(folder / "page.html"), engine="stdlib", output_dir=str(tmp_path / "out"), chunk_size=5, overlap=1)
    out = tmp_path / "out"
    assert got.output_dir.startswith(str(out / "page-")) and got.engine == "stdlib"
    assert sorted(p.name for p in next(out.iterdir()).iterdir()) == ["chunks.json", "document.json", "document.md", "engine.json"]
    assert [c["chunk_id"] for c in got.chunks] == list(range(len(got.chunks)))
    assert set(got.blocks[0]) == {"kind", "text", "depth", "page", "provenance", "reference"} and got.blocks[0]["page"] is None
    assert api.preview(got, 5) == (got.markdown[:5], got.chunks[:3])
    again = quillmill.parse_document(str(folder / "page.html"), engine="stdlib", output_dir=str(out), chunk_size=5, overlap=1)
    assert again == got and len(list(out.iterdir())) == 1
    with pytest.raises(FileExistsError):
        try:
            quillmill.parse_document(str(folder / "page.html"), engine="stdlib", output_dir=str(out))
        except PySparkException as e:
            raise FileExistsError from e if "FileExists" in str(e) else None
    adapters.register("docling", adapters.stdlib_engine)
    try:
        chunks = quillmill.extract_and_chunk("html", str(folder / "page.html"), output_dir=str(tmp_path / "two"), chunk_size=25, overlap=0)
    finally:
        adapters.register("docling", adapters.office_engine)
    assert chunks and {"source", "block_id", "char_start", "char_end", "chunk_id", "text"} <= set(chunks[0])
    with pytest.raises(TypeError):
        quillmill.extract("html", str(folder / "page.html"), engine="mineru")
    assert {p: e for p, (e, _) in api.PRESETS.items()}["audio"] == "qwen-asr" and len(api.PRESETS) == 10


def test_registered_engine_and_sinks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"RIFF")
    stamps = [{"text": f"w{i}", "start_time": float(i), "end_time": i + 1.0} for i in range(40)]
    document = json.dumps({"timestamps": True, "results": [{"text": "t", "language": "en", "time_stamps": stamps}]})
    before = adapters.ADAPTERS["qwen-asr"]
    adapters.register("qwen-asr", lambda device=None, timestamps=True: lambda data, name: (document, None, [("page-1/a.png", data)]))
    try:
        parsed = quillmill.parse_documents(spark, [str(tmp_path / "a.wav")], timestamps=True)
        assert [(b.start, b.end) for b in parsed.blocks.collect()] == [(0.0, 30.0), (30.0, 40.0)]
        assert parsed.documents.head().markdown == "t"
        sinks.write_tables(parsed, str(tmp_path / "tables"))
        assert spark.read.parquet(str(tmp_path / "tables/chunks")).count() == 2
        folder = sinks.write_files(parsed, str(tmp_path / "files")).head().folder
        raw = json.loads(open(f"{folder}/engine.json").read())
        assert open(f"{folder}/page-1/a.png", "rb").read() == b"RIFF"
        assert raw["transcripts"] == ["t"] and len(raw["segments"]) == 2 and len(raw["segments"][0]["words"]) == 30
        parsed.release()
    finally:
        adapters.register("qwen-asr", before)


def test_stream(spark, folder, tmp_path):
    (folder / "bad.pdf").write_bytes(b"x")
    chunks = stream_chunks(spark, str(folder), engine="stdlib", chunk_size=20, overlap=5)
    write_chunks(chunks, str(tmp_path / "sink"), str(tmp_path / "check")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "sink")).count()
    assert first > 10
    (folder / "more.html").write_text("<p>more</p>")
    write_chunks(stream_chunks(spark, str(folder), engine="stdlib", chunk_size=20, overlap=5), str(tmp_path / "sink"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == first + 1


def test_cli(spark, folder, tmp_path, capsys):
    from quillmill.__main__ import main

    main([str(folder / "t.csv"), "--engine", "stdlib", "--output-dir", str(tmp_path / "o")])
    assert capsys.readouterr().out.strip().startswith(str(tmp_path / "o" / "t-"))
    with pytest.raises(TypeError):
        main([str(folder / "t.csv"), "--tier", "standard", "--output-dir", str(tmp_path / "o")])
    with pytest.raises(SystemExit):
        main([str(folder / "t.csv"), "--engine", "none"])
