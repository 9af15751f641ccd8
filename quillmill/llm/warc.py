"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives a metadata record (application/warc-fields) with its HTTP status, its source
headers and its payload digest, and, if its payload is text, a conversion record (text/plain). Both
point back to the response by WARC-Refers-To with its target URI and date and carry its payload digest, and
their ids are made from the type and the response's id, so a second run gives the same records. All of it is one
projection without a shuffle; Arrow batches take HTTP messages apart. Files are written by Spark's text
writer, whose line separator is the blank lines that end a WARC record, and read as streams, a record at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import html as markup_rules
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
# Elements whose content is no text, and elements that break a line.
HIDDEN = ("script", "style", "noscript")
BREAKING = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "br", "tr", "table", "article", "section", "title", "head", "body", "html",
    "nav", "footer", "header", "main", "aside", "pre", "blockquote", "figure", "dl", "dd", "dt", "td", "th", "hr", "form",
)
# A comment, a hidden element, or a tag with quoted values; what is never closed reaches to the end. No branch can
# fail once it has begun (the tag's body is possessive), so the scan is linear whatever the markup.
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<hidden>{"|".join(HIDDEN)})\b.*?(?:</(?P=hidden)\s*>|\Z)"""
    r"""|</?(?P<tag>[a-z][^\s/>]*)(?:[^>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|["'=])*+(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
# Character references that end in a semicolon; what lacks it stays, as in the SQL counterpart.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# a lone space needs no replacement
_SPACES, _LINES = re.compile(r"[ \t\r\f]{2,}|[\t\r\f]"), re.compile(r" ?\n[ \n]*")


def _replacement(m: re.Match) -> str:
    if m["tag"]:
        return "\n" if m["tag"].lower() in BREAKING else ""
    return " " if m["hidden"] or m[0].startswith("<!--") else ""


def _reference(m: re.Match) -> str:
    known = m[0][1] == "#" or m[0][1:] in html5
    return markup_rules.unescape(m[0]).replace("\xa0", " ") if known else m[0]


def text_of(markup: str) -> str:
    """Plain text of HTML: comments and code go, block elements break lines, named and numeric character
    references are decoded once (a no-break space as a space; without the semicolon they stay), spaces are folded, ends are trimmed."""
    text = _MARKUP.sub(_replacement, markup)
    if "&" in text:
        text = _REFERENCE.sub(_reference, text)
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip(" \n")


def html_text(html: Column) -> Column:
    """text_of() of a column; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else text_of(t) for t in batch], dtype="object")

    return F.pandas_udf(run, "string")(html)


def _header(head: str, name: str) -> str:
    m = re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*)", head)
    return m[1].strip() if m else ""


def unchunk(body: bytes) -> bytes:
    """A chunked body put together; what is not in chunks stays as it is."""
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        if body[at : at + 2] != b"\r\n":
            break
        at += 2
    return b"".join(out) if out and at >= len(body) else body


def _inflated(body: bytes, coding: str) -> bytes | None:
    """The body without its content coding; None for a coding that has no decoder here, or a broken stream."""
    if coding in ("", "identity"):
        return body
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    if coding != "deflate" and body[:2] != b"\x1f\x8b":
        return body  # the crawler has decoded it and kept the header
    for bits in (47, -15) if coding == "deflate" else (47,):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return None


_CHARSET = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)


def decoded(body: bytes, kind: str, declared: str) -> str:
    """The text of a payload: by its byte order mark, the declared charset, the one that markup names in its first
    kilobyte, or UTF-8; bytes that don't fit are replaced, and Latin-1 is read as its superset windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    named = _CHARSET.search(body[:1024]) if not declared and "html" in kind else None
    charset = declared or (named[1].decode("ascii", "replace") if named else "utf-8")
    try:
        charset = codecs.lookup(charset).name
    except LookupError:
        charset = "utf-8"
    if charset in ("iso8859-1", "ascii"):
        charset = "cp1252"
    try:
        return body.decode(charset, "replace")
    except (UnicodeError, ValueError, LookupError):  # a codec that isn't one of text
        return body.decode("utf-8", "replace")


_MARKUP_KINDS = ("text/html", "application/xhtml+xml")
_MESSAGE = "source_status long, source_headers string, payload_digest string, text string"


def message(block: bytes | None) -> tuple[int | None, str, str, str | None]:
    """Status, header lines, payload digest and text (None if the payload is none) of an HTTP message."""
    head, _, payload = (block or b"").partition(b"\r\n\r\n")
    try:
        top = head.decode()
    except UnicodeDecodeError:
        top = head.decode("latin-1")
    status = re.match(r"HTTP/[0-9.]+ ([0-9]{3})", top)
    _, _, headers = top.partition(CRLF)
    kind = _header(headers, "Content-Type")
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", kind)
    kind = kind.partition(";")[0].strip().lower()
    text = None
    if kind.startswith("text/") or kind in _MARKUP_KINDS:
        body = unchunk(payload) if _header(headers, "Transfer-Encoding").lower() == "chunked" else payload
        body = _inflated(body, _header(headers, "Content-Encoding").lower())
        if body is not None:
            text = decoded(body, kind, charset[1] if charset else "")
            text = text_of(text) if kind in _MARKUP_KINDS else text
    return int(status[1]) if status else None, headers, "sha256:" + hashlib.sha256(payload).hexdigest(), text


def _messages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([message(b) for b in batch], columns=[f.split()[0] for f in _MESSAGE.split(", ")], dtype="object")


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def derive(responses: DataFrame) -> DataFrame:
    """Two records, or one, for each row of responses (record_id, target_uri, warc_date string, block string or binary, payload_digest string).

    block is the HTTP message: status line, headers, an empty line, payload. Columns of the result:
    record_id, record_type, refers_to, target_uri, warc_date, content_type, content_length,
    block_digest, payload_digest (of the source; if null, computed over the payload as it lies in the block),
    source_status, source_headers (lines joined by CRLF) and block (text). A null block counts as empty: a
    metadata record without status or headers, and no conversion. A payload that isn't text (by Content-Type), or
    whose content coding has no decoder here (any but gzip and deflate), has no conversion either. Chunked bodies
    are put together and charsets decoded, see decoded(). Null ids and repeated rows stay, texts of any length are
    taken whole. Other columns are ignored; an empty table gives an empty one.
    """
    own = F.pandas_udf(_messages, _MESSAGE).asNondeterministic()(F.col("block").cast("binary"))
    taken = responses.select("record_id", "target_uri", "warc_date", F.col("payload_digest").alias("given"), own.alias("m"))
    known = taken.select("record_id", "target_uri", "warc_date", "m.source_status", "m.source_headers", F.coalesce("given", "m.payload_digest").alias("payload_digest"), "m.text")
    text = F.col("text")
    lines = F.when(F.col("source_headers") != "", F.concat(F.lit("source-header: "), F.regexp_replace("source_headers", "\r\n", "\r\nsource-header: "), F.lit(CRLF))).otherwise("")
    fields = F.concat(
        F.when(F.col("source_status").isNotNull(), F.concat(F.lit("source-status: "), F.col("source_status").cast("string"), F.lit(CRLF))).otherwise(""),
        lines, F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
    )
    pair = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    each = known.select("record_id", "target_uri", "warc_date", "source_status", "source_headers", "payload_digest", F.explode(F.filter(pair, lambda r: r["block"].isNotNull())).alias("r")).select("*", "r.*")
    return each.select(
        record_id(F.col("record_type"), F.col("record_id")).alias("record_id"),
        "record_type",
        F.col("record_id").alias("refers_to"),
        "target_uri", "warc_date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"),
        "payload_digest", "source_status", "source_headers", "block",
    )


def record_text(derived: DataFrame) -> DataFrame:
    """One string a record: its WARC header and block, without the blank lines that end it."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    head = [
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Refers-To-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    ]
    return derived.select(F.concat(*head, F.col("block")).alias("value"))


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file for each partition, below path."""
    record_text(derived).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


_START = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes that are read from a file at once, and that a batch of records may reach before it is handed on.
READ_BYTES, BATCH_BYTES = 1 << 20, 8 << 20


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of a plain file, or of a gzip file of one member or many, uncompressed."""
    member, plain = None, None
    for chunk in chunks:
        if plain is None:
            plain = chunk[:2] != b"\x1f\x8b"
        while chunk and not plain:
            member = member or zlib.decompressobj(31)
            data = member.decompress(chunk, READ_BYTES)
            if data:
                yield data
            chunk = member.unused_data if member.eof else member.unconsumed_tail
            if member.eof:
                member = None
            elif not chunk:
                break
        if plain:
            yield chunk


def parse_warc(chunks: Iterator[bytes]) -> Iterator[dict[str, str | bytes]]:
    """Records of a WARC file that comes in chunks: header fields by lower-case name, and 'block'. Holds one record at a time."""
    chunks, held = _inflate(chunks), bytearray()

    def more() -> bool:
        got = next(chunks, b"")
        held.extend(got)
        return bool(got)

    while True:
        while (start := _START.search(held)) is None:
            del held[: max(0, len(held) - 16)]
            if not more():
                return
        del held[: start.start()]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        fields = (row.partition(":") for row in held[:end].decode("utf-8", "replace").split(CRLF)[1:])
        head = {name.strip().lower(): value.strip() for name, _, value in fields}
        length = head.get("content-length", "")
        size = int(length) if length.isdigit() else 0
        del held[: end + 4]
        while len(held) < size and more():
            pass
        yield head | {"block": bytes(held[:size])}
        del held[:size]


def _chunks(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path and local == path else local)
    with system.open_input_stream(at, compression=None) as stream:
        while chunk := stream.read(READ_BYTES):
            yield chunk


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, warc_date, payload_digest, block binary) of WARC files, plain or gzip.

    Spark lists the files; a task opens its own as streams and holds one batch of records, whatever the file's size.
    """
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest"]
    fields = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "block"]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r.get(n) for r in rows], pa.string()) for n in names), pa.array([r["block"] for r in rows], pa.binary())], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            rows, held = [], 0
            for name in files.column(0).to_pylist():
                for record in parse_warc(_chunks(name)):
                    rows.append(record)
                    held += len(record["block"])
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'block' else 'string'}" for n in fields))


def planned_responses(pages: DataFrame) -> DataFrame:
    """pages as response records, with a repeatable id and date and a plain HTTP head."""
    minute = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long") % 527_040
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(head, html).alias("block"),
        F.lit(None).cast("string").alias("payload_digest"),
    )


# Steps and entities of the SQL counterpart, in RE2 syntax; they cover the given pages, the ampersand comes last.
SQL_STEPS = [
    (r"(?is)<!--.*?-->", " "),
    (rf"(?is)<({'|'.join(HIDDEN)})\b.*?</({'|'.join(HIDDEN)})>", " "),
    (rf"(?i)</?({'|'.join(BREAKING)})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]
SQL_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
SQL_SPACES = [(r"[ \t\r\f]+", " "), (r" *\n[ \n]*", "\n")]


def sql() -> str:
    """DuckDB SQL of the derivatives of pages, with the same replacement tables."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = reduce(lambda x, s: f"regexp_replace({x}, {quote(s[0])}, {quote(s[1])}, 'g')", SQL_STEPS, "html")
    text = reduce(lambda x, s: f"replace({x}, {quote(s[0])}, {quote(s[1])})", SQL_ENTITIES, text)
    text = reduce(lambda x, s: f"regexp_replace({x}, {quote(s[0])}, {quote(s[1])}, 'g')", SQL_SPACES, text)
    uuid = lambda x: f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"
    return f"""
WITH p AS (
  SELECT {uuid("'response|' || page_id || '|' || url")} AS refers_to, url AS target_uri, html, 'sha256:' || sha256(html) AS payload_digest,
    strftime(TIMESTAMP '2024-01-01' + to_minutes((('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 527040)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS source_headers
  FROM pages
), r AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-status: 200' || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || 'source-payload-digest: ' || payload_digest || chr(13) || chr(10) AS block FROM p
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', trim({text}, ' ' || chr(10)) FROM p
)
SELECT {uuid("record_type || '|' || refers_to")} AS record_id, record_type, refers_to, target_uri, warc_date, content_type, strlen(block) AS content_length,
  'sha256:' || sha256(block) AS block_digest, payload_digest, 200::BIGINT AS source_status, source_headers, block
FROM r
"""
