"""Cutting text into overlapping chunks by packing paragraphs.

Chunks depend on those before them in a text, so a text is one unit of work: an Arrow pass that emits the exploded rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 1_000
OVERLAP = 120
LEAST = 8

WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PARAGRAPH = re.compile(r"\n\n|\r\n\r\n")
_BLANK = re.compile(f"[{WHITE}]+")


def paragraphs(text: str) -> list[str]:
    """What lies between blank lines, stripped, without empty ones."""
    return [p for p in (part.strip(WHITE) for part in _PARAGRAPH.split(text)) if p]


def tail(text: str, n: int) -> str:
    """The last ``n`` characters from the first white space among them on; all of them if there is none."""
    if len(text) <= n:
        return text
    end = text[-n:]
    blank = _BLANK.search(end)
    return end[blank.end() :] if blank else end


def sentence_windows(text: str, target: int = TARGET) -> Iterator[str]:
    """Windows of at most ``target`` characters, each ended behind its last full stop before a blank, if it has one."""
    at = 0
    while len(text) - at > target:
        stop = text.rfind(". ", at, at + target)
        end = stop + 1 if stop >= 0 else at + target
        if piece := text[at:end].strip(WHITE):
            yield piece
        at = end
    if piece := text[at:].strip(WHITE):
        yield piece


def _packed(text: str, target: int, overlap: int) -> Iterator[str]:
    held = ""
    for para in paragraphs(text):
        oversized = len(para) > target
        if held and (oversized or len(held) + len(para) + 1 > target):
            done = held.strip(WHITE)
            if done:
                yield done
            carried = "" if oversized else tail(done, overlap)
            held = f"{carried} " if carried else ""
        if oversized:
            yield from sentence_windows(para, target)
        else:
            held += f"{para}\n"
    if last := held.strip(WHITE):
        yield last


def chunk_text(text: str | None, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of a text; none for null or blank ones.

    Paragraphs are packed up to ``target`` characters, and a chunk that follows a full one begins with its last words, up
    to ``overlap`` characters, which are not counted again. Longer paragraphs are windowed by themselves, without overlap.
    Chunks under ``least`` characters are dropped. Lengths are code points.
    """
    return [c for c in _packed(text or "", target, overlap) if len(c) >= least]


def chunk_sections(sections, **options) -> list[tuple[str, int | None]]:
    """Chunks of (text, page) sections, each with its page; none runs over two sections."""
    return [(c, page) for text, page in sections or [] for c in chunk_text(text, **options)]


def chunk_rows(df: DataFrame, keys: list[str], text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``keys``, ``ordinal`` (0-based) and ``text`` of the chunks of each row; rows without chunks give none."""
    return _exploded(df, keys, text, lambda t: chunk_text(t, target, overlap))


def window_rows(df: DataFrame, keys: list[str], text: str = "text", target: int = TARGET) -> DataFrame:
    """As ``chunk_rows`` for the windows of each text; a null text has none."""
    return _exploded(df, keys, text, lambda t: list(sentence_windows(t or "", target)))


def _exploded(df: DataFrame, keys: list[str], text: str, cut) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [cut(t) for t in batch.column(len(keys)).to_pylist()]
            at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            ordinals = pa.array([j for c in found for j in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), ordinals, pa.array([x for c in found for x in c], pa.string())], names=[*keys, "ordinal", "text"])

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text)).mapInArrow(run, f"{names}, ordinal int, text string")


def chunk_section_rows(df: DataFrame, keys: list[str], sections: str = "sections", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """As ``chunk_rows`` for a column of sections: ``keys``, ``ordinal`` running over all sections, ``text``, ``page``."""

    def run(batches):
        for batch in batches:
            found = [chunk_sections([(s["text"], s["page"]) for s in own or []], target=target, overlap=overlap) for own in batch.column(len(keys)).to_pylist()]
            at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            flat = [x for c in found for x in c]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(len(keys))), pa.array([j for c in found for j in range(len(c))], pa.int32()), pa.array([t for t, _ in flat], pa.string()), pa.array([p for _, p in flat], pa.int32())],
                names=[*keys, "ordinal", "text", "page"],
            )

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(sections)).mapInArrow(run, f"{names}, ordinal int, text string, page int")
