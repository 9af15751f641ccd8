"""Office, web, mail and table files parsed with the standard library, to the raw shape of the office engine."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from email import policy
from email.parser import BytesParser
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

_BOILERPLATE = {"nav": "nav", "footer": "footer"}
_SKIP = {"script", "style", "noscript", "template"}
_LABELS = {"title": "title", "h1": "section_header", "h2": "section_header", "h3": "section_header", "h4": "section_header", "h5": "section_header", "h6": "section_header", "li": "list_item", "caption": "caption"}
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
# stands for ampersands that begin no reference: a lone surrogate, which neither decoded bytes nor references give
_MARK = "\udc26"
_BREAKS = set(_LABELS) | {"p", "div", "ul", "ol", "br", "tr", "table", "article", "section", "head", "body", "html", "header", "footer", "nav", "main", "pre", "blockquote", "figure", "td", "th"}


def markdown_rows(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(c.replace("\n", " ").replace("|", "\\|") for c in [*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


class _Items:
    """Collects items in reading order and numbers their references."""

    def __init__(self) -> None:
        self.items: list[dict] = []

    def add(self, label: str, text: str = "", depth: int = 1, page: int | None = None, **more) -> None:
        if not text and not more:
            return
        kind = {"table": "tables", "picture": "pictures"}.get(label, "texts")
        number = sum(i["self_ref"].startswith(f"#/{kind}/") for i in self.items) if len(self.items) < 1000 else len(self.items)
        self.items.append({"label": label, "text": text, "depth": depth, "prov": [] if page is None else [{"page_no": page}], "self_ref": f"#/{kind}/{number}", **more})

    def markdown(self) -> str:
        out = []
        for i in self.items:
            text = i.get("markdown") or i.get("caption") or i["text"]
            out.append({"title": f"# {text}", "section_header": f"## {text}", "list_item": f"- {text}"}.get(i["label"], text))
        return "\n\n".join(x for x in out if x)


class _Html(HTMLParser):
    def __init__(self, out: _Items):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.held, self.skip = out, [], [], 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        outer = next((_BOILERPLATE[t] for t in self.stack if t in _BOILERPLATE), None)
        label = outer or next((_LABELS[t] for t in reversed(self.stack) if t in _LABELS), "text")
        self.out.add(label, text, depth=max(1, len(self.stack)))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
            return
        if tag == "img":
            self._flush()
            alt = next((v for k, v in attrs if k == "alt" and v), "")
            self.out.add("picture", caption=alt, depth=max(1, len(self.stack)))
            return
        if tag == "table" and self.rows is None:
            self._flush()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif tag in _BREAKS:
            self._flush()
        if tag in _BREAKS and tag != "br":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.rows is not None:
            if tag in ("td", "th") and self.cell is not None:
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "table":
                rows = [r for r in self.rows if r]
                self.rows = None
                if rows:
                    self.out.add("table", depth=max(1, len(self.stack)), markdown=markdown_rows(rows))
        elif tag in _BREAKS:
            self._flush()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.rows is None:
            self.held.append(data)

    def close(self):
        super().close()
        self._flush()
        if self.rows:
            self.out.add("table", markdown=markdown_rows([r for r in self.rows if r]))


def parse_html(data: bytes, bare_references: bool = True) -> _Items:
    """bare_references: names and numbers that lack the semicolon are references too, as in browsers; otherwise they
    stay as written, in texts and captions."""
    out = _Items()
    declared = re.search(rb"charset=[\"']?([\w-]+)", data[:2048])
    try:
        text = data.decode(declared[1].decode() if declared else "utf-8")
    except (LookupError, UnicodeDecodeError):
        text = data.decode("utf-8", "replace")
    if not bare_references:
        text = _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else _MARK + m[0][1:], text)
    parser = _Html(out)
    parser.feed(text.removeprefix("﻿"))
    parser.close()
    if not bare_references:
        for item in out.items:
            item.update({k: item[k].replace(_MARK, "&") for k in ("text", "markdown", "caption") if k in item})
    return out


def parse_mail(data: bytes, bare_references: bool = True) -> _Items:
    """Subject, addresses and body; signature and quoted reply are tagged, not removed."""
    message = BytesParser(policy=policy.default).parsebytes(data)
    out = _Items()
    if message["subject"]:
        out.add("title", str(message["subject"]))
    for name in ("from", "to", "cc", "date"):
        if message[name]:
            out.add("text", f"{name.title()}: {message[name]}")
    body = message.get_body(("plain", "html"))
    if body is None:
        return out
    if body.get_content_type() == "text/html":
        for item in parse_html(body.get_content().encode(), bare_references).items:
            out.items.append(item)
        return out
    label = "text"
    for part in re.split(r"\n\s*\n", body.get_content().replace("\r\n", "\n")):
        lines = part.strip("\n").split("\n")
        for line in lines:
            if line.rstrip() == "--":
                label = "signature"
        quoted = all(x.startswith(">") for x in lines if x.strip()) and any(x.strip() for x in lines)
        text = "\n".join(x.rstrip() for x in lines if x.rstrip() != "--").strip()
        if text:
            out.add("quote" if quoted else label, text)
    return out


def read_table(data: bytes, delimiter: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=delimiter))


def tsv_to_csv(data: bytes) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(read_table(data, "\t"))
    return out.getvalue().encode()


def parse_csv(data: bytes) -> _Items:
    out = _Items()
    rows = [r for r in read_table(data, ",") if r]
    if rows:
        out.add("table", markdown=markdown_rows(rows))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _joined(element, text_tag: str) -> str:
    return "".join(x.text or "" for x in element.iter(text_tag))


def parse_docx(data: bytes) -> _Items:
    out = _Items()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for x in body:
        if x.tag == f"{_W}p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "").lower()
            listed = x.find(f"{_W}pPr/{_W}numPr") is not None or name.startswith("list")
            label = "title" if name == "title" else "section_header" if name.startswith("heading") else "list_item" if listed else "text"
            out.add(label, _joined(x, f"{_W}t").strip())
            if x.find(f".//{_W}drawing") is not None:
                described = next((d.get("descr") for d in x.iter() if d.tag.endswith("}docPr") and d.get("descr")), "")
                out.add("picture", caption=described)
        elif x.tag == f"{_W}tbl":
            rows = [["\n".join(filter(None, (_joined(p, f"{_W}t") for p in cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in x.findall(f"{_W}tr")]
            out.add("table", markdown=markdown_rows(rows))
    return out


def parse_pptx(data: bytes) -> _Items:
    out = _Items()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for page, name in enumerate(slides, 1):
            tree = ElementTree.fromstring(z.read(name))
            for shape in (x for x in tree.iter() if x.tag.endswith("}sp") or x.tag == f"{_A}tbl"):
                if shape.tag == f"{_A}tbl":
                    out.add("table", page=page, markdown=markdown_rows([[_joined(c, f"{_A}t") for c in row.findall(f"{_A}tc")] for row in shape.findall(f"{_A}tr")]))
                    continue
                holder = next((x.get("type", "") for x in shape.iter() if x.tag.endswith("}ph")), "")
                for p in shape.iter(f"{_A}p"):
                    out.add("title" if "itle" in holder else "text", _joined(p, f"{_A}t").strip(), page=page)
    return out


def parse_xlsx(data: bytes) -> _Items:
    out = _Items()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_joined(x, f"{_S}t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for page, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        column = 26 * column + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = c.findtext(f"{_S}v") or ""
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else _joined(c, f"{_S}t") if c.get("t") == "inlineStr" else value)
                if any(cells):
                    rows.append(cells)
            if rows:
                out.add("table", page=page, markdown=markdown_rows(rows))
    return out


PARSERS = {
    ".html": parse_html, ".htm": parse_html, ".eml": parse_mail, ".csv": parse_csv, ".tsv": lambda data: parse_csv(tsv_to_csv(data)),
    ".docx": parse_docx, ".pptx": parse_pptx, ".xlsx": parse_xlsx,
}


def parse_office(data: bytes, suffix: str, bare_references: bool = True) -> tuple[str, str]:
    """Raw JSON and Markdown of a file. bare_references is for web files and mails in HTML, see parse_html."""
    if suffix not in PARSERS:
        raise RuntimeError(f"no parser is installed for {suffix or 'a file without suffix'}")
    parse = PARSERS[suffix]
    found = parse(data, bare_references) if parse in (parse_html, parse_mail) else parse(data)
    return json.dumps({"status": "success", "items": found.items}, ensure_ascii=False), found.markdown()
