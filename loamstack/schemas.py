"""Schemas of the store's tables and of what the operators exchange."""

from __future__ import annotations

SCHEMA_VERSION = 2
DIMS = 384

DOCS = "path string, content_hash string, mtime_secs bigint, size bigint, n_chunks int"
CHUNKS = "chunk_key bigint, path string, ordinal int, text string, page int"
VECTORS = "chunk_key bigint, path string, ordinal int, embedding array<float>"
POSTINGS = "field string, term string, chunk_key bigint, path string, ordinal int, tf bigint, len bigint"
FIELD_LEN = "field string, chunk_key bigint, path string, len bigint"
TABLES = {"docs": DOCS, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "field_len": FIELD_LEN}

SECTIONS = "array<struct<text:string,page:int>>"
FILES = "path string, size bigint, mtime_secs bigint, ext string"
HITS = "path string, chunk_index int, score double, text string, page int, rank int"
