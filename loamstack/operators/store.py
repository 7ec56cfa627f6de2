"""The index as segments of Parquet tables under one manifest.

A change writes a segment with the new rows of the changed paths and the list of paths whose older rows it replaces, and
then publishes a manifest that names the segments. A row holds if no later segment replaces its path. So an update costs
what it changes, not what is stored; readers keep the manifest they opened. Segments have levels: as soon as there are
``FAN`` of one level at the end they are merged into one of the next, so n updates leave some FAN x log n segments, and a
row is rewritten once a level.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.io import local
from loamstack.operators import bm25, stats
from loamstack.operators.embed import Embedder, HashedWords, embed_rows
from loamstack.publish import Heads, Overtaken
from loamstack.schemas import SCHEMA_VERSION, TABLES
from loamstack.session import cut_lineage, ship

#: Segments of one level at the end of the list that are merged into one of the next level.
FAN = 8


@dataclass
class Manifest:
    version: int = 0
    schema_version: int = SCHEMA_VERSION
    next_key: int = 0
    segments: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)


def due(levels: list[int], fan: int = FAN) -> int:
    """How many segments at the end are to be merged: all of the last one's level, once there are ``fan``."""
    n = 0
    while n < len(levels) and levels[-1 - n] == levels[-1]:
        n += 1
    return n if n >= fan else 0


def dense_ids(df: DataFrame, order: list[str], name: str, start: int) -> tuple[DataFrame, int]:
    """Consecutive numbers from ``start`` in the given order, and the next free one.

    Rows are range-partitioned and sorted; the driver only adds up the partitions' row counts.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}
    firsts, at = [], start
    for p in sorted(counts):
        firsts.append((p, at))
        at += counts[p]
    table = local(df.sparkSession, firsts, "_p bigint, _first bigint")
    numbered = rows.withColumn("_p", part).join(F.broadcast(table), "_p")
    return numbered.withColumn(name, F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_first"), at


class Store:
    """A store in ``folder``. ``refresh`` it, or open it again, to see what others have published since.

    A manifest that cannot be read is passed over. Without any that can be read, a folder that has manifests is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder
        self.heads = Heads(spark, folder, "manifest")
        if not self.heads.numbers():
            try:
                self.heads.publish(0, Manifest().__dict__)
            except Overtaken:
                pass
        self.refresh()

    # ---- manifest ----

    def refresh(self) -> Store:
        self._taken, found = self.heads.newest()
        if found is None:
            raise RuntimeError(f"no manifest of {self.folder} can be read")
        self.manifest = Manifest(**found)
        self._stats = None
        return self

    def _publish(self, next_key: int, segments: list[str], levels: list[int]) -> None:
        """Publish the next manifest; a writer that was overtaken fails (StaleWriter) and changes nothing."""
        manifest = Manifest(self._taken + 1, self.manifest.schema_version, next_key, segments, levels)
        self.heads.publish(manifest.version, manifest.__dict__)
        self._taken, self.manifest, self._stats = manifest.version, manifest, None

    def schema_matches(self) -> bool:
        return self.manifest.schema_version == SCHEMA_VERSION

    def next_chunk_key(self) -> int:
        """The key after the greatest ever given; keys are not given twice."""
        return self.manifest.next_key

    # ---- reading ----

    def _rows(self, name: str, schema: str, first: int) -> DataFrame:
        """All rows of a table from segment ``first`` on, held or replaced, with the place ``_at`` of their segment: one scan."""
        segments = self.manifest.segments[first:]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s}/{name}" for s in segments))
        if len(segments) == 1:
            return rows.withColumn("_at", F.lit(0))
        places = F.create_map(*(F.lit(x) for i, s in enumerate(segments) for x in (s, i)))
        return rows.withColumn("_at", F.element_at(places, F.regexp_extract("_metadata.file_path", rf"(segment-[0-9a-f]+)/{name}/", 1)))

    def _replaced(self, first: int = 0) -> DataFrame:
        return self._rows("replaced", "path string", first).groupBy("path").agg(F.max("_at").alias("at"))

    def table(self, name: str, first: int = 0) -> DataFrame:
        """Rows of a table that hold, looking at the segments from ``first`` on. With one segment this is a plain scan, so
        filters and columns are pushed down; with several they are as well, and what is left is held against what was replaced."""
        schema = TABLES[name]
        segments = self.manifest.segments[first:]
        if not segments:
            return local(self.spark, [], schema)
        rows = self._rows(name, schema, first)
        if len(segments) > 1:
            rows = rows.join(self._replaced(first), "path", "left").where(F.col("at").isNull() | (F.col("_at") >= F.col("at")))
        return rows.select(*(c.split()[0] for c in schema.split(", ")))

    def docs(self) -> DataFrame:
        return self.table("docs")

    def iter_chunks(self) -> DataFrame:
        return self.table("chunks").orderBy("path", "ordinal")

    def stats(self) -> DataFrame:
        return stats.totals(self.docs(), self.table("chunks"))

    def field_stats(self) -> DataFrame:
        """Rows and mean length of each field, as BM25 needs them; computed once for a manifest."""
        if self._stats is None:
            self._stats = [tuple(r) for r in bm25.field_stats(self.table("field_len")).collect()]
        return local(self.spark, self._stats, "field string, n double, avg double")

    # ---- writing ----

    def _write(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables of a new segment side by side; its name."""
        name = f"segment-{uuid.uuid4().hex}"
        with ThreadPoolExecutor(len(tables)) as pool:
            for job in [pool.submit(df.write.parquet, f"{self.folder}/{name}/{table}") for table, df in tables.items()]:
                job.result()
        return name

    def _segment(self, replaced: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, next_key: int, fresh: bool = False, level: int = 0) -> None:
        """Write and publish a segment of ``chunks``, which must be at hand (no lineage to compute), and what follows from them."""
        posted = bm25.postings(chunks.withColumn("_p", F.col("path")), fields={"text": "text", "path": "_p"}, keep=("path", "ordinal"))
        name = self._write({"replaced": replaced.select("path").distinct(), "docs": docs, "chunks": chunks, "vectors": vectors, "postings": _laid_out(posted), "field_len": _lengths(chunks)})
        m = self.manifest
        self._publish(next_key, [name] if fresh else [*m.segments, name], [level] if fresh else [*m.levels, level])
        while n := due(self.manifest.levels):
            if not self._merge(n):
                break

    def _merge(self, n: int) -> bool:
        """Merge the last ``n`` segments into one of the next level; False if another writer was first."""
        m = self.manifest
        first = len(m.segments) - n
        rows = {name: self.table(name, first) for name in TABLES}
        rows["postings"] = _laid_out(rows["postings"])
        gone = self._rows("replaced", "path string", first).select("path").distinct()
        name = self._write({"replaced": gone if first else gone.limit(0), **rows})
        try:
            self._publish(m.next_key, [*m.segments[:first], name], [*m.levels[:first], m.levels[-1] + 1])
        except Overtaken:
            self.heads.remove(name)
            self.refresh()
            return False
        return True

    def upsert(self, docs: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, vectors: DataFrame | None = None, keep_keys: bool = False, done=None) -> None:
        """Replace the documents of ``docs`` (path, content_hash, mtime_secs, size) by their new ``chunks`` (path, ordinal,
        text, page), all tables in one publication. A document without chunks stays known as empty.

        Vectors are made by ``embedder`` or given as (path, ordinal, embedding). Of repeated paths or chunks one counts.
        With ``keep_keys`` the chunks bring keys of their own (``chunk_key``), which must be new to the store. ``done`` is an accumulator of
        the chunks that were embedded.
        """
        docs = docs.dropDuplicates(["path"])
        known = chunks.where("path is not null").dropDuplicates(["path", "ordinal"]).join(docs.select("path"), "path", "left_semi")
        if "page" not in known.columns:
            known = known.withColumn("page", F.lit(None).cast("int"))
        kept = ["chunk_key", "path", F.col("ordinal").cast("int").alias("ordinal"), "text", F.col("page").cast("int").alias("page")]
        if keep_keys:
            keyed = cut_lineage(known.select(*kept).repartitionByRange("chunk_key").sortWithinPartitions("chunk_key"))
            after = max(self.manifest.next_key, (keyed.agg(F.max("chunk_key")).first()[0] or -1) + 1)
        else:
            keyed, after = dense_ids(known.select("path", "ordinal", "text", "page"), ["path", "ordinal"], "chunk_key", self.manifest.next_key)
            keyed = keyed.select(*kept)
        if vectors is not None:
            made = keyed.join(vectors.select("path", "ordinal", "embedding"), ["path", "ordinal"]).select("chunk_key", "path", "ordinal", F.col("embedding").cast("array<float>").alias("embedding"))
        else:
            made = embed_rows(keyed, embedder or HashedWords(), ["chunk_key", "path", "ordinal"], done=done)
        counts = keyed.groupBy("path").agg(F.count("*").cast("int").alias("n_chunks"))
        meta = docs.join(counts, "path", "left").select("path", "content_hash", "mtime_secs", "size", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        self._segment(docs, meta, keyed, made, after)

    def touch(self, docs: DataFrame) -> None:
        """Renew the metadata of documents whose content is the same; their chunks and vectors are carried over."""
        paths = docs.select("path").distinct()
        old = self.docs().select("path", "n_chunks")
        meta = docs.dropDuplicates(["path"]).join(old, "path").select("path", "content_hash", "mtime_secs", "size", "n_chunks")
        self._segment(paths, meta, self.table("chunks").join(paths, "path", "left_semi"), self.table("vectors").join(paths, "path", "left_semi"), self.manifest.next_key)

    def delete(self, paths: DataFrame) -> int:
        """Remove documents with all their rows; the number of those that were there, empty ones included."""
        gone = cut_lineage(self.docs().join(paths.select("path").distinct(), "path", "left_semi").select("path"))
        n = gone.count()
        if n:
            none = {name: local(self.spark, [], TABLES[name]) for name in ("docs", "chunks", "vectors")}
            self._segment(gone, **none, next_key=self.manifest.next_key)
        return n

    def clear(self) -> None:
        """Forget all documents; the schema version stays."""
        self._publish(self.manifest.next_key, [], [])

    def rebuild(self) -> None:
        """Compute postings and lengths anew from the chunks, folding all segments into one."""
        none = local(self.spark, [], "path string")
        self._segment(none, self.docs(), self.table("chunks"), self.table("vectors"), self.manifest.next_key, fresh=True, level=max([0, *self.manifest.levels]))

    compact = rebuild

    def intact(self) -> bool:
        """Whether the keyword tables can be opened and fit the chunks, which have two lengths each. Only footers are read."""
        if not self.manifest.segments:
            return True
        try:
            n = {name: self._rows(name, TABLES[name], 0).count() for name in ("chunks", "field_len", "postings")}
        except Exception:  # noqa: BLE001 - a damaged file may fail in any way
            return False
        return n["field_len"] == 2 * n["chunks"]

    def repair(self) -> bool:
        """Rebuild the keyword tables if they are damaged or do not fit the chunks; whether that was needed."""
        if self.intact():
            return False
        self.rebuild()
        return True

    def vacuum(self, retain: float = 86_400.0) -> int:
        """Remove manifests older than ``retain`` seconds, but for the last one, and segments that none of the others
        names and that are as old; the number of things removed. Readers that opened an older manifest must be done by then."""
        old, ages = time.time() - retain, self.heads.ages()
        numbers = self.heads.numbers()
        kept = {n for n in numbers if ages.get(f"manifest-{n}.json", old) >= old} | {self.manifest.version, numbers[-1]}
        used = {s for n in kept for s in (self.heads.read(n) or {"segments": []})["segments"]}
        gone = [f"manifest-{n}.json" for n in numbers if n not in kept] + [n for n, at in ages.items() if n.startswith("segment-") and n not in used and at < old]
        for name in gone:
            self.heads.remove(name)
        return len(gone)


def _laid_out(posted: DataFrame) -> DataFrame:
    """Postings as they are stored: those of a term together and in order, so that a scan skips the other terms, but those
    of a term that every chunk has in as many tasks and files as there are runs of a million keys."""
    return posted.repartition("term", F.shiftright("chunk_key", 20)).sortWithinPartitions("term", "field", "chunk_key")


def _lengths(chunks: DataFrame) -> DataFrame:
    """Number of terms of each field of each chunk."""
    rows = chunks.select(F.struct("chunk_key", "path").alias("row"), "text", F.col("path").alias("_p"))
    return bm25.field_len(rows, "row", {"text": "text", "path": "_p"}).select("field", "row.chunk_key", "row.path", "len")
