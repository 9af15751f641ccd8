"""Scalar functions on text and on JSON content."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import let

#: Every character that counts as white space when a text is stripped; there is none beyond U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Kinds that contain one of these words stay whole when cut into chunks.
ATOMIC_KINDS = ("table", "equation", "formula")
# Keys of structured content, by priority.
CONTENT_KEYS = ("text", "html", "content", "table_body", "latex")


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it and not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_atomic(kind: Column) -> Column:
    """Whether a block of this kind is never cut; case matters, a null kind may be cut."""
    known = F.coalesce(kind, F.lit(""))
    found = F.lit(False)
    for word in ATOMIC_KINDS:
        found = found | F.contains(known, F.lit(word))
    return found


def content_of(value) -> str:
    """Text of a JSON value: the first known key of an object decides, even if it holds null."""
    match value:
        case None:
            return ""
        case str():
            return value
        case list():
            return "\n".join(map(content_of, value))
        case dict():
            for key in CONTENT_KEYS:
                if key in value:
                    return content_of(value[key])
            return json.dumps(value, ensure_ascii=False)
    return str(value)


def content_text(document: Column) -> Column:
    """Text of a JSON document given as a string. In Python, as it alone keeps an object's dump and numbers as written."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "" if v is None else content_of(json.loads(v)))

    return F.pandas_udf(run, "string")(document)


def join_ordered(items: Column, by: str, value: str, separator: str) -> Column:
    """Values of an array of structs, joined in the order of one of their fields."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x[by].alias("o"), x[value].alias("v"))))
    return F.array_join(F.transform(ordered, lambda x: x["v"]), separator)


def join_texts(texts: Column) -> Column:
    """Transcripts or page links as one Markdown text."""
    return F.array_join(texts, "\n\n")


def page_link(page: Column, path: Column) -> Column:
    """Markdown link to a page's own file."""
    return F.concat(F.lit("[Page "), page.cast("string"), F.lit("]("), F.replace(path, F.lit("\\"), F.lit("/")), F.lit(")"))


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]+\z"), F.regexp_replace(name, r"(?s)\.[^.]*\z", "")).otherwise(name)


def output_name(name: Column, identity: Column) -> Column:
    """Folder of a document: its stem and twelve hex digits of its identity."""
    return F.concat(stem(name), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 12))


def preview(markdown: Column, size: int = 2000) -> Column:
    return F.substring(markdown, 1, size)


def markdown_cell(cell: Column) -> Column:
    """A cell's text: null is empty, a line break is a space, a bar is escaped."""
    return F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>>, the header first, as a Markdown table; shorter rows are filled up, an empty array gives an empty text."""
    width = F.array_max(F.transform(rows, F.size))

    def table(width: Column) -> Column:
        def line(cells: Column) -> Column:
            filled = F.concat(F.transform(cells, markdown_cell), F.array_repeat(F.lit(""), width - F.size(cells)))
            return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
        return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n")

    return F.when(F.size(rows) > 0, let(width, table)).otherwise("")
