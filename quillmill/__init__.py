"""Document extraction and chunking on Spark. Importing it loads no engine."""

from quillmill.api import Parsed, ParsedDocument, extract, extract_and_chunk, parse_document, parse_documents

__all__ = ["Parsed", "ParsedDocument", "extract", "extract_and_chunk", "parse_document", "parse_documents"]
