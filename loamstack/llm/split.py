"""Cutting oversized texts at natural boundaries (problem 2).

A giant text is worked on in ranges, each with a halo of one character before and one piece behind. A cut depends on nothing
beyond one piece from where a piece begins, so a range can say for every place at which a piece may enter it where the
first piece beyond it begins and how many pieces lie between. Such tables are stitched in a tree: the table of two ranges
is the one put behind the other, so blocks of ranges get tables of the same size, and from the top down each range learns
its entry and its first ordinal. The ranges then emit their pieces by offset. Files are read by byte ranges, so no task
holds a whole file; a text in a column is a value of its row, and only that row's task holds it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstack.session import cut_lineage, ship

LIMIT = 1_000
OVERLAP = 120
RANGE = 1 << 16

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_SPACE = f"[{WHITE_SPACE}]"
# Boundaries from the strongest to the weakest; a piece ends where a match ends.
_PARAGRAPH = re.compile("(?:\r?\n[ \t]*){2,}| ")
_LINE = re.compile("\r?\n|[ \u0085]|\r(?!\n)")
_SENTENCE = re.compile(f"[.!?…]+[\"'”’»)\\]]*{_SPACE}+|[。！？]")
_WORD = re.compile(f"{_SPACE}+")
_JOINED = re.compile("[̀-ͯ‍︀-️]")


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    found = -1
    for m in pattern.finditer(text, low, high):
        found = m.end()
    return found


def next_cut(text: str, start: int, limit: int, overlap: int) -> tuple[int, int]:
    """End of the piece that begins at ``start`` of a text that goes on beyond ``start + limit``, and the next start.

    The strongest kind of boundary in the later half of the piece wins; a word's end may also lie in the earlier half,
    as long as the piece is longer than twice the overlap. Without any, the cut is at the limit, before no combining mark.
    """
    high = start + limit
    half = start + max(limit // 2, 2 * overlap + 1)
    cut = -1
    for pattern in (_PARAGRAPH, _LINE, _SENTENCE):
        cut = _last(pattern, text, half, high)
        if cut > 0:
            break
    if cut <= 0:
        cut = _last(_WORD, text, half, high)
    if cut <= 0:
        cut = _last(_WORD, text, start + 2 * overlap + 1, half)
    if cut <= 0:
        cut = high
        while cut > half and _JOINED.match(text, cut):
            cut -= 1
    back = cut - overlap
    if overlap <= 0:
        return cut, cut
    if text[back - 1] not in WHITE_SPACE:
        m = _WORD.search(text, back, cut)
        if m is not None and m.end() < cut:
            back = m.end()
    return cut, back


def _pieces(text: str, start: int, stop: int, size: int, limit: int, overlap: int):
    """Pieces that begin in [start, stop) of a text of ``size`` characters of which ``text`` is at hand."""
    while start < stop:
        if size - start <= limit:
            yield start, size
            return
        cut, following = next_cut(text, start, limit, overlap)
        yield start, cut
        start = following


def oversized(df: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows whose text, without white space at both ends, has more than ``limit`` code points; ``body`` is that text.

    Decided in the JVM before anything is shuffled. Null, empty and blank texts are never oversized.
    """
    return df.where(F.length(text) > limit).withColumn("body", F.btrim(F.col(text), F.lit(WHITE_SPACE))).where(F.length("body") > limit)


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without repeated ones, by a digest of the body. Only bodies that do occur again are shuffled."""
    rows = df.withColumn("_digest", F.sha2("body", 256))
    names = [*keys, "_digest"]
    twice = rows.groupBy(*names).count().where("count > 1").select(*(F.col(n).alias(f"_2{n}") for n in names))
    same = None
    for n in names:
        # Null keys are equal too.
        one = F.col(n).eqNullSafe(F.col(f"_2{n}"))
        same = one if same is None else same & one
    again = rows.join(twice, same, "left_semi").groupBy(*names).agg(F.first("body").alias("body"))
    return rows.join(twice, same, "left_anti").select(*keys, "body").unionByName(again.select(*keys, "body"))


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """``keys``, ``ordinal``, ``start``, ``length`` and ``piece`` of every oversized text.

    Offsets are code points of the trimmed text. Pieces are never over ``limit``; consecutive ones share at most
    ``overlap`` characters and together cover the text without a gap. Each row is cut by itself, so no piece runs over two
    sections. Repeated rows count once; rows of equal keys and different texts are cut each. Other texts give no rows.
    Texts of one range are cut where they are, longer ones by ranges; both give the same pieces.
    """
    base = _once(oversized(df, text, limit).select(*keys, "body"), keys)
    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    size = F.length("body")
    out = f"{names}, ordinal bigint, start bigint, length bigint, piece string"

    def direct(frames):
        for frame in frames:
            rows = [(*row[:-1], i, a, b - a, row[-1][a:b]) for row in frame.itertuples(index=False, name=None) for i, (a, b) in enumerate(_pieces(row[-1], 0, len(row[-1]), len(row[-1]), limit, overlap))]
            yield _typed(rows, [*keys, "ordinal", "start", "length", "piece"], frame)

    whole = base.where(size <= range_chars).mapInPandas(direct, out)

    def ranged(frames):
        names = [*keys, "_item", "_size", "_range", "_first", "_stop", "_from", "_part"]
        for frame in frames:
            for *own, item, body in frame.itertuples(index=False, name=None):
                # A giant's ranges go on in small batches.
                for low in range(0, len(body), 16 * range_chars):
                    rows = []
                    for first in range(low, min(low + 16 * range_chars, len(body)), range_chars):
                        at = max(first - 1, 0)
                        rows.append((*own, item, len(body), first // range_chars, first, min(first + range_chars, len(body)), at, body[at : first + range_chars + limit + 1]))
                    yield _typed(rows, names, frame)

    long = base.where(size > range_chars).withColumn("_item", F.xxhash64(*keys, "body")).select(*keys, "_item", "body")
    ranges = long.mapInPandas(ranged, f"{names}, _item bigint, _size bigint, _range bigint, _first bigint, _stop bigint, _from bigint, _part string").repartition("_item", "_range")

    def tables(frames):
        for frame in frames:
            yield pd.DataFrame([(item, number, *_table(part, begin, first, stop, size_, limit, overlap)) for item, size_, number, first, stop, begin, part in frame.itertuples(index=False, name=None)], columns=_TABLE)

    made = ranges.select("_item", "_size", "_range", "_first", "_stop", "_from", "_part").mapInPandas(tables, _TABLES)
    # A column's text has at most 2^31 bytes, so two levels reach over all its ranges.
    entries = _stitched(made, 2)

    def emit(frames):
        for frame in frames:
            rows = []
            for *own, size_, stop, begin, part, entry, ordinal in frame[[*keys, "_size", "_stop", "_from", "_part", "_entry", "_ordinal"]].itertuples(index=False, name=None):
                rows += [(*own, ordinal + i, a + begin, b - a, part[a:b]) for i, (a, b) in enumerate(_pieces(part, entry - begin, stop - begin, size_ - begin, limit, overlap))]
            yield _typed(rows, [*keys, "ordinal", "start", "length", "piece"], frame)

    return whole.unionByName(ranges.join(entries, ["_item", "_range"]).mapInPandas(emit, out))


# ---- tables of entries and exits ------------------------------------------------------------------------------------

#: Ranges, or blocks of them, that are put together into one block.
FAN = 256
_TABLE = ["_item", "_range", "first", "leave", "n"]
_TABLES = "_item bigint, _range bigint, first bigint, leave array<bigint>, n array<bigint>"


def _table(part: str, begin: int, first: int, stop: int, size: int, limit: int, overlap: int) -> tuple[int, np.ndarray, np.ndarray]:
    """For a piece that enters the range ``first`` to ``stop`` at its d-th place, for all d under ``limit``: where the first
    piece beyond the range begins, and how many begin in it. ``part`` is the text from ``begin`` on, of ``size`` in all."""
    after: dict[int, tuple[int, int]] = {}
    leave, n = np.arange(first, first + limit, dtype=np.int64), np.zeros(limit, dtype=np.int64)
    for d in range(min(limit, max(0, stop - first))):
        at, trail = first + d, []
        while at < stop and at not in after:
            trail.append(at)
            at = size if size - at <= limit else next_cut(part, at - begin, limit, overlap)[1] + begin
        out, k = after.get(at, (at, 0))
        for back in reversed(trail):
            k += 1
            after[back] = (out, k)
        leave[d], n[d] = after.get(first + d, (first + d, 0))
    return first, leave, n


def _stitched(tables: DataFrame, levels: int) -> DataFrame:
    """``_item``, ``_range``, ``_entry`` and ``_ordinal`` of the ranges that a piece begins in, of tables of up to FAN ** ``levels``
    ranges an item. A task has the tables of FAN ranges or blocks at once."""

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_range")
        leave = n = None
        for first, own, k in zip(frame["first"], frame["leave"], frame["n"]):
            own, k = np.asarray(own, dtype=np.int64), np.asarray(k, dtype=np.int64)
            # A piece may step over a range that is shorter than a piece; it then enters a later one. It may also end the text.
            at = None if leave is None else np.minimum(leave - first, len(own) - 1)
            leave, n = (own, k) if leave is None else (np.where(leave - first < len(own), own[at], leave), np.where(leave - first < len(own), n + k[at], n))
        return pd.DataFrame([(frame["_item"].iloc[0], frame["_range"].iloc[0] // FAN, frame["first"].iloc[0], leave, n)], columns=_TABLE)

    def apart(above: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(above):
            return pd.DataFrame([], columns=["_item", "_range", "_entry", "_ordinal"])
        at, ordinal, rows = int(above["_entry"].iloc[0]), int(above["_ordinal"].iloc[0]), []
        for item, number, first, leave, n in frame.sort_values("_range").itertuples(index=False, name=None):
            d = at - first
            if 0 <= d < len(leave) and (n[d] or leave[d] != at):
                rows.append((item, number, at, ordinal))
                at, ordinal = int(leave[d]), ordinal + int(n[d])
        return pd.DataFrame(rows, columns=["_item", "_range", "_entry", "_ordinal"])

    stack = [tables]
    for _ in range(levels - 1):
        up = stack[-1].withColumn("_block", F.floor(F.col("_range") / FAN))
        stack.append(up.groupBy("_item", "_block").applyInPandas(lambda frame: together(frame[_TABLE]), _TABLES))
    schema = "_item bigint, _range bigint, _entry bigint, _ordinal bigint"
    entries = stack[-1].select("_item").distinct().select(F.col("_item").alias("_item"), F.lit(0).cast("bigint").alias("_range"), F.lit(0).cast("bigint").alias("_entry"), F.lit(0).cast("bigint").alias("_ordinal"))
    for below in reversed(stack):
        down = below.withColumn("_block", F.floor(F.col("_range") / FAN))
        entries = entries.groupBy("_item", "_range").cogroup(down.groupBy("_item", "_block")).applyInPandas(lambda above, frame: apart(above, frame[_TABLE]), schema)
    return entries


# ---- files ----------------------------------------------------------------------------------------------------------

BYTES = 1 << 20


def _opened(path: str):
    """A file by its path or URI, for reading at offsets."""
    files, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), re.sub("^file:", "", path))
    return files.open_input_file(inside)


def _bounded(file, start: int, stop: int, size: int, limit: int) -> tuple[str, str, str]:
    """Of the characters that begin in the bytes ``start`` to ``stop``: the one before, themselves, and a piece behind them."""
    low, high = max(0, start - 4), min(size, stop + 4 * (limit + 4))
    raw = file.read_at(high - low, low)

    def border(at: int) -> int:
        at -= low
        for i in range(at, min(at + 4, len(raw))):
            if raw[i] & 0xC0 != 0x80:
                return i
        return min(at, len(raw)) if at + 4 <= len(raw) else len(raw)

    a, b = (border(start) if start else 0), border(stop) if stop < size else len(raw)
    before = raw[:a].decode("utf-8", "replace")[-1:]
    return before, raw[a:b].decode("utf-8", "replace"), raw[b:].decode("utf-8", "replace")[: limit + 2]


def split_files(spark: SparkSession, uri: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = BYTES) -> DataFrame:
    """``path``, ``ordinal``, ``start``, ``length`` and ``piece`` of every file under ``uri`` that is over ``limit``, as UTF-8.

    As ``split_oversized`` for the decoded text; a file of any size is read by ranges of ``range_bytes``, twice, and what
    moves between tasks are tables of places. Invalid bytes become U+FFFD. Smaller and empty files give no rows.
    """
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", F.col("length").alias("_bytes")).where(F.col("_bytes") > limit)
    most = listed.agg(F.max("_bytes")).first()[0] or 1
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_bytes") - 1) / range_bytes))
    ranges = listed.select("path", F.xxhash64("path").alias("_item"), "_bytes", F.explode(starts).alias("_range")).repartition("_item", "_range")

    def reading(row, use):
        path, size, number = row
        with _opened(path) as file:
            return use(*_bounded(file, number * range_bytes, min((number + 1) * range_bytes, size), size, limit))

    def measure(frames):
        for frame in frames:
            rows = []
            for path, item, size, number in frame[["path", "_item", "_bytes", "_range"]].itertuples(index=False, name=None):
                own = reading((path, size, number), lambda _, own, __: own)
                left = len(own) - len(own.lstrip(WHITE_SPACE))
                rows.append((path, item, size, number, len(own), left if left < len(own) else -1, len(own.rstrip(WHITE_SPACE))))
            yield pd.DataFrame(rows, columns=["path", "_item", "_bytes", "_range", "chars", "low", "high"])

    measured = cut_lineage(ranges.mapInPandas(measure, "path string, _item bigint, _bytes bigint, _range bigint, chars bigint, low bigint, high bigint"))
    # A row of numbers for each range.
    upto = Window.partitionBy("_item").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = measured.withColumn("at", F.coalesce(F.sum("chars").over(upto), F.lit(0)))
    body = placed.where("low >= 0").groupBy("_item").agg(F.min(F.col("at") + F.col("low")).alias("_low"), F.max(F.col("at") + F.col("high")).alias("_high")).where(F.col("_high") - F.col("_low") > limit)
    inside = cut_lineage(
        placed.join(body, "_item").select(
            "path", "_item", "_bytes", "_range", (F.col("_high") - F.col("_low")).alias("_size"), (F.col("at") - F.col("_low")).alias("_at"),
            F.greatest(F.col("at") - F.col("_low"), F.lit(0)).alias("_first"), F.least(F.col("at") + F.col("chars") - F.col("_low"), F.col("_high") - F.col("_low")).alias("_stop"),
        ).where("_stop > _first").withColumn("_range_", F.row_number().over(Window.partitionBy("_item").orderBy("_range")).cast("bigint") - 1)
    )

    def parts(row, at: int, end: int) -> tuple[str, int]:
        """The text at hand and the place of its first character in the body, which ends at ``end``."""
        return reading(row, lambda before, own, behind: ((before + own + behind)[: end - (at - len(before))], at - len(before)))

    def tables(frames):
        for frame in frames:
            rows = []
            for path, item, size, number, whole, at, first, stop, nth in frame.itertuples(index=False, name=None):
                part, begin = parts((path, size, number), at, whole)
                rows.append((item, nth, *_table(part, begin, first, stop, whole, limit, overlap)))
            yield pd.DataFrame(rows, columns=_TABLE)

    spread = inside.repartition("_item", "_range")
    levels = max(1, math.ceil(math.log(max(2, most // range_bytes + 1), FAN)))
    entries = _stitched(spread.mapInPandas(tables, _TABLES), levels).withColumnRenamed("_range", "_range_")

    def emit(frames):
        for frame in frames:
            rows = []
            for path, size, number, whole, at, stop, entry, ordinal in frame[["path", "_bytes", "_range", "_size", "_at", "_stop", "_entry", "_ordinal"]].itertuples(index=False, name=None):
                part, begin = parts((path, size, number), at, whole)
                rows += [(path, ordinal + i, a + begin, b - a, part[a:b]) for i, (a, b) in enumerate(_pieces(part, entry - begin, stop - begin, whole - begin, limit, overlap))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "start", "length", "piece"])

    return inside.join(entries, ["_item", "_range_"]).mapInPandas(emit, "path string, ordinal bigint, start bigint, length bigint, piece string")


def _typed(rows: list, columns: list[str], like: pd.DataFrame) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=columns)
    for name in columns:
        if name in like.columns and made[name].dtype != like[name].dtype:
            made[name] = made[name].astype(like[name].dtype)
    return made


def split_tables(sections: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Pieces of both tables: ``item_kind``, ``item_id``, ``path``, ``page`` and what ``split_oversized`` gives."""
    both = sections.select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "path", "page", "text").unionByName(
        chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_key").alias("item_id"), "path", "page", "text")
    )
    return split_oversized(both, ["item_kind", "item_id", "path", "page"], **options)
