import quillmill
from quillmill import samples


def test_files_are_kept_unless_overwritten(tmp_path):
    assert len(samples.generate(str(tmp_path))) == 4
    (tmp_path / "sample.csv").write_bytes(b"own")
    assert {p.name for p in samples.generate(str(tmp_path), documents=True)} == set(samples.DOCUMENTS)
    assert (tmp_path / "sample.csv").read_bytes() == b"own"
    assert len(samples.generate(str(tmp_path), documents=True, overwrite=True)) == 9
    assert (tmp_path / "sample.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_samples_parse(spark, tmp_path):
    samples.generate(str(tmp_path), documents=True)
    parsed = quillmill.parse_documents(spark, str(tmp_path), strict=False)
    failed = {r.source.rsplit("/", 1)[1] for r in parsed.raw.filter("error IS NOT NULL").collect()}
    assert failed == {"sample.png", "sample-text.pdf"}  # their engines aren't installed
    tables = [r.text for r in parsed.blocks.filter("kind = 'table'").collect()]
    assert len(tables) == 5 and all("Valve, brass" in t and "two lines" in t for t in tables)
    kinds = {r.kind for r in parsed.blocks.filter("source LIKE '%.eml'").collect()}
    assert {"title", "text", "signature", "quote"} <= kinds
    assert [r.page for r in parsed.blocks.filter("source LIKE '%.pptx' AND kind = 'title'").orderBy("block_id").collect()] == [1, 2]
    parsed.release()
