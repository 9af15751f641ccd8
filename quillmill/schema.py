"""One block schema for all engines; a field an engine doesn't give is null."""

from __future__ import annotations

from pyspark.sql import types as T

WORD = "struct<text:string,start:double,end:double>"
BLOCK_FIELDS = {
    "kind": "string",
    "text": "string",
    "page": "bigint",
    "depth": "bigint",
    "bbox": "string",
    "provenance": "string",
    "reference": "string",
    "language": "string",
    "start": "double",
    "end": "double",
    "words": f"array<{WORD}>",
    "raw": "string",
}
BLOCK = f"struct<{','.join(f'{name}:{kind}' for name, kind in BLOCK_FIELDS.items())}>"
BLOCKS = f"array<{BLOCK}>"
#: Fields that each engine's blocks carry, for sinks that leave absent keys out.
ENGINE_FIELDS = {
    "mineru": ["kind", "text", "page", "raw"],
    "docling": ["kind", "text", "depth", "page", "provenance", "reference"],
    "stdlib": ["kind", "text", "depth", "page", "provenance", "reference"],
    "paddleocr": ["kind", "text", "page", "bbox", "raw"],
    "qwen-asr": ["kind", "text", "language", "start", "end", "words"],
}


def struct_type(ddl: str) -> T.DataType:
    return T.DataType.fromDDL(ddl)
