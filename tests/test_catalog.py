import pytest

from quillmill import catalog
from quillmill.plans import routing
from quillmill.sources import adapters, parsers

CUT = ["R&amp;D &amp", "R&amp;D &am", "say &quot", "say &quo", "a &amp;&amp; b &", "&copy 2024 &copy; &middot", "&ampx; &amp;amp; &amp;amp"]
PAGE = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p><b>{0} and</b> more</p><footer>&copy; {0}</footer></body></html>"


def test_web_pages_with_cut_references(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = spark.createDataFrame([(i, PAGE.format(x)) for i, x in enumerate(CUT)], "page_id bigint, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.web_pages(spark, str(tmp_path))
    columns = ", ".join(got.columns)
    wanted = con.sql(f"SELECT {columns} FROM ({catalog.oracle_sql()['web_pages']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert wanted[0][1] == "R&D &amp"


def test_bare_references():
    html = "<p>&copy 2024 &lt;&#233;&#xe9; R&ampD &notit; &#233 &unknown; a&b</p><img alt='x &copy 1 &copy;'><table><tr><td>&amp &amp;</td></tr></table><p> &amp</p>".encode()
    texts = lambda **options: [i.get("markdown") or i.get("caption") or i["text"] for i in parsers.parse_html(html, **options).items]
    assert texts() == ["© 2024 <éé R&D ¬it; é &unknown; a&b", "x © 1 ©", "| & & |\n| --- |", " &"]
    assert texts(bare_references=False) == ["&copy 2024 <éé R&ampD &notit; &#233 &unknown; a&b", "x &copy 1 ©", "| &amp & |\n| --- |", " &amp"]


def test_no_character_is_taken_for_an_ampersand():
    html = "<p>\ue000 &#xE000; \ufdd0 &#xDC26; &#56358; &amp</p>".encode()
    assert parsers.parse_html(html, bare_references=False).items[0]["text"] == "\ue000 \ue000 \ufdd0 \ufffd \ufffd &amp"


def test_bare_references_are_an_option_of_the_offline_engine():
    routing.check_options(["stdlib"], {"bare_references": False})
    with pytest.raises(TypeError):
        routing.check_options(["docling"], {"bare_references": False})
    mail = b"Subject: s\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>a &amp</p>\r\n"
    for data, name in ((b"<p>a &amp</p>", "x.html"), (mail, "x.eml")):
        assert adapters.stdlib_engine()(data, name)[1].endswith("a &")
        assert adapters.stdlib_engine(bare_references=False)(data, name)[1].endswith("a &amp")
    assert adapters.stdlib_engine(bare_references=False)(b"k,v\r\n1,&amp\r\n", "x.csv")[1].endswith("| 1 | &amp |")
