"""Indexing a directory tree incrementally, or single files, into a store."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.chunking import chunk_section_rows
from loamstack.functions.text import under_root
from loamstack.operators.embed import BATCH, Embedder, HashedWords
from loamstack.operators.store import Store
from loamstack.session import cut_lineage
from loamstack.sources import corpus


@dataclass(frozen=True)
class Options:
    """``no_prune``: keep what is gone from the tree. ``force``: index again what is unchanged. ``retry_empty``: try files
    again that had no text. ``strict_stat``: take a file whose time changed as changed, without comparing its content."""

    no_prune: bool = False
    force: bool = False
    retry_empty: bool = False
    strict_stat: bool = False


#: Paths a report names; it counts all.
NAMED = 10_000


@dataclass
class Report:
    """What a pass did. ``indexed`` and ``failed`` name the first ``NAMED`` paths, the numbers count all."""

    indexed: list[str] = field(default_factory=list)
    skipped_unchanged: int = 0
    removed_missing: int = 0
    failed: list[str] = field(default_factory=list)
    n_indexed: int = 0
    n_failed: int = 0

    def __str__(self) -> str:
        tail = f", failed {self.n_failed}" if self.n_failed else ""
        return f"indexed {self.n_indexed}, unchanged {self.skipped_unchanged}, pruned {self.removed_missing}{tail}"

    def summary(self) -> str:
        """The report as a sentence or two for its reader; a pass over a tree without any file says so."""
        if not self.n_indexed and not self.skipped_unchanged and not self.n_failed:
            return f"{self}\nNothing to index: no file under this folder has a known extension and a size under the limit."
        return "\n".join([str(self), *(f"failed: {path}" for path in self.failed)])


class Progress:
    """Tells, while chunks are embedded, of each window of ``BATCH`` chunks that is done. ``tell`` gets ``done`` and ``total``."""

    def __init__(self, context, tell: Callable[[str, dict], None], total: int):
        self.tell, self.total, self.told = tell, total, 0
        self.done = context.accumulator(0)
        self._over = threading.Event()

    def _advance(self, upto: int) -> None:
        upto = min(upto, self.total)
        for n in range(self.told + BATCH, upto + 1, BATCH):
            self.told = n
            self.tell("embedding", {"done": n, "total": self.total, "batch": BATCH})

    def _watch(self) -> None:
        while not self._over.wait(0.2):
            self._advance(self.done.value)

    def __enter__(self) -> Progress:
        self.tell("embedding", {"done": 0, "total": self.total, "batch": BATCH})
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._over.set()
        self._thread.join()
        if kind is None:
            self._advance(self.total)
            if self.told < self.total:
                self.tell("embedding", {"done": self.total, "total": self.total, "batch": BATCH})


def change_set(scan: DataFrame, known: DataFrame, options: Options = Options()) -> DataFrame:
    """``scan`` (path, size, mtime_secs, ext) with ``action``: read or unchanged, decided by what a listing tells.

    A file is unchanged if size and whole-second time are those of the store. One of the same size and second with other
    content is missed; that is the price of not reading it.
    """
    old = known.select("path", F.col("size").alias("_size"), F.col("mtime_secs").alias("_mtime"), F.col("content_hash").alias("_hash"), "n_chunks")
    same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_mtime").eqNullSafe(F.col("mtime_secs")) & F.col("_size").isNotNull()
    again = F.lit(options.force) | (F.lit(options.retry_empty) & (F.col("n_chunks") == 0))
    return scan.join(old, "path", "left").withColumn("action", F.when(same & ~F.coalesce(again, F.lit(False)), "unchanged").otherwise("read"))


def missing(known: DataFrame, scan: DataFrame, root: str) -> DataFrame:
    """Stored paths under ``root`` that the walk did not see."""
    inside = F.col("path").startswith(root.rstrip("/") + "/") if "://" in root else under_root(F.col("path"), root)
    return known.where(inside).select("path").join(scan.select("path"), "path", "left_anti")


def index_directory(
    store: Store, root: str, extensions: Iterable[str] = (), options: Options = Options(), extractors: Iterable[corpus.Extractor] = (),
    embedder: Embedder | None = None, progress: Callable[[str, dict], None] | None = None, each: Callable[[str, int, int], None] | None = None,
) -> Report:
    """One pass over the tree. ``root`` is a local folder or the URI of one on any Hadoop file system (no extractors there).
    ``progress`` is told of the steps and of each window of chunks embedded, ``each`` of every file found: its path, place
    and the total. A walk error raises before anything is written; a file's own failure leaves its older version
    in the index and is tried again at the next pass. All changed documents are published together, then what is gone from
    the tree and from the disk is pruned, under the root only."""
    tell = progress or (lambda *_: None)
    extractors = list(extractors)
    if not store.schema_matches():
        raise RuntimeError("the store has another schema version; rebuild it in a new folder")
    store.repair()
    if remote := "://" in root:
        scan = cut_lineage(corpus.listed(store.spark, root, extensions))
    else:
        root = corpus.absolute_path(root)
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        scan = corpus.files(store.spark, root, extensions, extractors)
    total = scan.count()
    tell("discovered", {"total": total})
    if each is not None:
        for i, row in enumerate(scan.select("path").toLocalIterator()):
            each(row["path"], i + 1, total)
    known = store.docs()
    changes = change_set(scan, known, options)
    report = _apply(store, changes, options, extractors, embedder, tell, total)
    if not options.no_prune:
        gone = missing(known, scan, root)
        # Only paths that the walk did not see are looked up on disk, by the tasks that hold them. A remote listing is
        # the whole truth of its extensions.
        if not remote:
            gone = gone.mapInPandas(lambda frames: (f[[not os.path.lexists(p) for p in f["path"]]] for f in frames), "path string")
        gone = cut_lineage(gone)
        report.removed_missing = store.delete(gone)
    tell("finished", {"report": report})
    return report


def _apply(store, changes, options, extractors, embedder, tell, total) -> Report:
    report = Report(skipped_unchanged=changes.where("action = 'unchanged'").count())
    todo = changes.where("action = 'read'")
    read = corpus.read_listed(todo) if "uri" in todo.columns else corpus.read_sections(todo, extractors)
    sections = cut_lineage(read.join(todo.select("path", "size", "mtime_secs", "_hash", "n_chunks"), "path"))
    # A touched file with the same content keeps its chunks.
    same = (F.col("_hash") == F.col("content_hash")) & ~F.lit(options.force) & ~F.lit(options.strict_stat) & ~(F.lit(options.retry_empty) & (F.col("n_chunks") == 0))
    marked = sections.withColumn("same", F.coalesce(same, F.lit(False)) & (F.col("status") != "error"))
    counts = dict(marked.groupBy("status").count().collect())
    report.n_failed = counts.get("error", 0)
    report.failed = _named(marked.where("status = 'error'")) if report.n_failed else []
    touched = marked.where("same")
    n = touched.count()
    if n:
        report.skipped_unchanged += n
        store.touch(touched.select("path", "content_hash", "mtime_secs", "size"))
    new = marked.where("not same and status <> 'error'")
    tell("scanned", {"done": total, "total": total})
    docs = new.select("path", "content_hash", "mtime_secs", "size")
    fresh = dict(new.groupBy("status").count().collect())
    report.n_indexed = fresh.get("ok", 0)
    report.indexed = _named(new.where("status = 'ok'")) if report.n_indexed else []
    if fresh:
        chunks = cut_lineage(chunk_section_rows(new, ["path"]))
        with Progress(store.spark.sparkContext, tell, chunks.count()) as progress:
            store.upsert(docs, chunks, embedder or HashedWords(), done=progress.done)
    return report


def _named(files: DataFrame) -> list[str]:
    return [r[0] for r in files.select("path").orderBy("path").limit(NAMED).collect()]


def index_one(store: Store, path: str, extractors: Iterable[corpus.Extractor] = (), embedder: Embedder | None = None) -> int:
    """Index one file whatever its extension, size or state; the number of its chunks, of which there must be one."""
    path = corpus.absolute_path(path)
    st = os.stat(path)
    row = [(path, st.st_size, max(0, int(st.st_mtime // 1)), corpus.ext_of(os.path.basename(path)))]
    scan = store.spark.createDataFrame(row, "path string, size bigint, mtime_secs bigint, ext string")
    read = cut_lineage(corpus.read_sections(scan, list(extractors)).join(scan.drop("ext"), "path"))
    status, error = read.select("status", "error").first()
    if status == "error":
        raise ValueError(f"{path}: {error}")
    chunks = cut_lineage(chunk_section_rows(read, ["path"]))
    n = chunks.count()
    if n == 0:
        raise ValueError(f"{path}: no chunks")
    store.upsert(read.select("path", "content_hash", "mtime_secs", "size"), chunks, embedder or HashedWords())
    return n


def index_table(store: Store, docs: DataFrame, embedder: Embedder | None = None) -> int:
    """Index a table of ``path`` and ``text`` whose content differs from the store's; the number of documents indexed.

    The way for corpora that are tables already: nothing passes through the driver. Null paths are left out, null and
    blank texts are remembered as empty documents.
    """
    given = docs.where("path is not null").groupBy("path").agg(F.max("text").alias("text"))
    hashed = given.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    old = store.docs().select("path", F.col("content_hash").alias("_hash"))
    new = cut_lineage(hashed.join(old, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_hash"))
    n = new.count()
    if n:
        sections = new.select("path", F.array(F.struct("text", F.lit(None).cast("int").alias("page"))).alias("sections"))
        meta = new.select("path", "content_hash", F.lit(0).cast("bigint").alias("mtime_secs"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
        store.upsert(meta, chunk_section_rows(sections, ["path"]), embedder or HashedWords())
    return n
