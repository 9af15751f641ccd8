"""Sample inputs for trying the formats, made with the standard library.

python -m quillmill.samples FOLDER [--documents] [--overwrite]: web page, mail and tables, and with
--documents also office files, an image and a PDF. Files that exist are kept unless --overwrite is given.
"""

from __future__ import annotations

import argparse
import io
import struct
import zipfile
import zlib
from email.message import EmailMessage
from email.policy import SMTP
from html import escape
from pathlib import Path

TABLE = [["Part", "Stock", "Remark"], ["Valve, brass", "40", "invented"], ["Gasket", "7", "two\nlines"]]
PARAGRAPHS = ["All parts and numbers in this sample are invented.", "Stock is counted on the first day of a month."]


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def web_page() -> bytes:
    rows = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in TABLE)
    body = "".join(f"<p>{escape(p)}</p>" for p in PARAGRAPHS)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Stock list</title></head><body><nav>Start | Contact</nav><h1>Stock</h1>{body}<h2>Parts</h2><ul><li>Valves</li><li>Gaskets</li></ul><table>{rows}</table><footer>Page foot</footer></body></html>".encode()


def mail() -> bytes:
    m = EmailMessage(policy=SMTP)
    m["Subject"], m["From"], m["To"], m["Date"] = "Stock für März", "depot@example.com", "office@example.com", "Fri, 01 Mar 2024 09:00:00 +0000"
    m.set_content("\n\n".join([*PARAGRAPHS, "- valves\n- gaskets", "--\nThe depot", "> How many are left?"]), cte="8bit")
    return m.as_bytes()


def table(delimiter: str) -> bytes:
    import csv

    out = io.StringIO(newline="")
    csv.writer(out, delimiter=delimiter).writerows(TABLE)
    return ("﻿" + out.getvalue()).encode()


def word_file() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>'
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in TABLE)
    return _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p("Stock list", "Title")}{p("Parts", "Heading1")}{"".join(map(p, PARAGRAPHS))}<w:tbl>{rows}</w:tbl></w:body></w:document>'})


def slides() -> bytes:
    slide = lambda title, text: f'<p:sld xmlns:p="urn:p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:sp><p:ph type="title"/><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:sp></p:sld>'
    return _zip({f"ppt/slides/slide{n}.xml": slide(f"Slide {n}", text) for n, text in enumerate(PARAGRAPHS, 1)})


def workbook() -> bytes:
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = lambda n, row: "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for k, c in enumerate(row))
    rows = "".join(f"<row>{cells(n, row)}</row>" for n, row in enumerate(TABLE, 1))
    return _zip(
        {
            "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Stock" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
        }
    )


def image(width: int = 64, height: int = 32) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes((x ^ y) & 255 for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def pdf() -> bytes:
    content = b"BT /F1 12 Tf 72 720 Td (" + PARAGRAPHS[0].encode() + b") Tj ET"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    rows = b"".join(b"%010d 00000 n \n" % at for at in places)
    return out + b"xref\n0 6\n0000000000 65535 f \n" + rows + b"trailer << /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


BASIC = {"sample.html": web_page, "sample.eml": mail, "sample.csv": lambda: table(","), "sample.tsv": lambda: table("\t")}
DOCUMENTS = {"sample.docx": word_file, "sample.pptx": slides, "sample.xlsx": workbook, "sample.png": image, "sample-text.pdf": pdf}


def generate(folder: str, documents: bool = False, overwrite: bool = False) -> list[Path]:
    """The files written."""
    root, written = Path(folder), []
    root.mkdir(parents=True, exist_ok=True)
    for name, make in (BASIC | DOCUMENTS if documents else BASIC).items():
        if overwrite or not (root / name).exists():
            (root / name).write_bytes(make())
            written.append(root / name)
    return written


if __name__ == "__main__":
    parser = argparse.ArgumentParser(prog="quillmill.samples")
    parser.add_argument("folder")
    parser.add_argument("--documents", action="store_true")
    parser.add_argument("--overwrite", action="store_true")
    got = parser.parse_args()
    print(*generate(got.folder, got.documents, got.overwrite), sep="\n")
