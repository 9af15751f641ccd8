"""Which engine parses a file, and checks that come before any work."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffixes each engine takes.
SUFFIXES = {
    "mineru": [".pdf"],
    "paddleocr": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"],
    "docling": [".docx", ".pptx", ".xlsx", ".csv", ".tsv", ".html", ".htm", ".eml", ".msg"],
    "qwen-asr": [".wav", ".mp3", ".flac", ".m4a", ".ogg"],
}
#: The last one is never routed to, only named.
ENGINES = (*SUFFIXES, "stdlib")
#: Options that each engine takes.
OPTIONS = {"mineru": {"tier"}, "docling": set(), "stdlib": {"bare_references"}, "paddleocr": {"device"}, "qwen-asr": {"device", "timestamps"}}
TIERS = ("standard", "advanced")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def suffix(name: Column) -> Column:
    """Lower-case last suffix with its dot; empty for names like '.pdf', 'a.' or 'a'."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def routed_engine(name: Column) -> Column:
    """Engine by suffix; null if there is none."""
    routes = F.create_map(*[F.lit(x) for engine, own in SUFFIXES.items() for s in own for x in (s, engine)])
    return routes[suffix(name)]


def choose_engine(name: Column, engine: str | Column = "auto") -> Column:
    """The routed engine, or the given one, which isn't held against the suffix. An unknown engine gives null."""
    given = F.lit(engine) if isinstance(engine, str) else engine
    return F.when(given == "auto", routed_engine(name)).when(given.isin(*ENGINES), given)


def rejects(files: DataFrame, path_col: str = "path", engine: str | Column = "auto") -> DataFrame:
    """Files that no engine takes, with the reason."""
    name = file_name(F.col(path_col))
    reason = F.concat(F.lit("unsupported engine or suffix: "), F.when(suffix(name) == "", "none").otherwise(suffix(name)))
    return files.filter(choose_engine(name, engine).isNull()).withColumn("reason", reason)


def check_options(engines: Iterable[str], options: dict) -> None:
    """TypeError for an option that one of the engines doesn't take, ValueError for a wrong tier."""
    for engine in engines:
        unknown = set(options) - OPTIONS[engine]
        if unknown:
            raise TypeError(f"{engine} takes no option {', '.join(sorted(unknown))}")
    if "tier" in options and options["tier"] not in TIERS:
        raise ValueError(f"tier must be one of {', '.join(TIERS)}")
