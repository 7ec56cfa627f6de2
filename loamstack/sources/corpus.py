"""Directory trees as a source: which files there are, and their text.

A local tree is walked by the driver, as links, cycles and unreadable folders must be seen, and read by tasks; each worker
must have it mounted. A tree on a Hadoop file system is listed and read by Spark's own binary file source, in parallel.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions.text import ext_of as column_ext
from loamstack.schemas import FILES

# Extensions of text files, and names of folders that hold no documents.
EXTENSIONS = (
    "md", "markdown", "txt", "rst", "json", "yaml", "yml", "toml", "csv", "tsv", "html", "htm", "xml", "log", "rs", "py", "js", "jsx", "ts", "tsx",
    "go", "c", "h", "cpp", "hpp", "java", "rb", "sh", "bash", "zsh", "sql", "proto", "graphql", "dockerfile", "makefile", "ini", "cfg", "conf", "env",
)
IGNORED_DIRS = ("node_modules", "target", "dist", "build", "venv", "__pycache__", "vendor")
MAX_FILE_BYTES = 8 << 20
BOM = b"\xef\xbb\xbf"


class NoText(Exception):
    """A readable file without text: it is remembered as empty and not tried again."""


class WalkError(OSError):
    """A part of the tree could not be walked; nothing is indexed then."""


def is_ignored_dir(name: str) -> bool:
    return name.startswith(".") or name in IGNORED_DIRS


def ext_of(name: str) -> str | None:
    """Lower-cased extension; none for names that only begin with a dot. Some names are their own extension."""
    low = name.lower()
    if low in ("dockerfile", "makefile"):
        return low
    stem, dot, ext = low.rpartition(".")
    return ext if dot and stem else None


def absolute_path(path: str) -> str:
    """Absolute without resolving links, except where '..' needs the file system."""
    return os.path.realpath(path) if ".." in Path(path).parts else os.path.normpath(os.path.join(os.getcwd(), path))


@dataclass
class Extractor:
    """A user's way to get sections out of files: extensions, a size limit, and ``extract(path)`` giving (text, page) pairs.

    ``extract`` raises NoText for a readable file without text; any other error is tried again at the next pass.
    """

    extensions: tuple[str, ...]
    extract: Callable[[str], list[tuple[str, int | None]]]
    max_file_bytes: int = MAX_FILE_BYTES


def find_extractor(extractors: Iterable[Extractor], ext: str | None) -> Extractor | None:
    """The extractor for an extension, without case; of several the one given last."""
    found = None
    for e in extractors:
        if ext is not None and ext.lower() in (x.lower() for x in e.extensions):
            found = e
    return found


@dataclass
class Found:
    path: str
    size: int
    mtime_secs: int
    ext: str | None = field(default=None)


def discover(root: str, extensions: Iterable[str] = (), extractors: Iterable[Extractor] = ()) -> list[Found]:
    """Files under ``root``, sorted by path. Links are followed; a broken link, a cycle or an unreadable folder raises WalkError.

    Folders with a dot or an ignored name are not entered, the root itself always is. Files larger than the limit of their
    extractor (8 MiB without) are left out, as are those of other extensions.
    """
    extractors = list(extractors)
    allowed = {*EXTENSIONS, *(e.lower().lstrip(".") for e in extensions), *(x.lower() for e in extractors for x in e.extensions)}
    found: list[Found] = []

    def walk(folder: str, above: tuple[tuple[int, int], ...]) -> None:
        try:
            own = os.stat(folder)
            names = sorted(os.listdir(folder))
        except OSError as error:
            raise WalkError(f"cannot walk {folder}: {error}") from error
        mark = (own.st_dev, own.st_ino)
        if mark in above:
            raise WalkError(f"{folder} leads back to a folder above it")
        for name in names:
            path = os.path.join(folder, name)
            try:
                st = os.stat(path)
            except OSError as error:
                raise WalkError(f"cannot follow {path}: {error}") from error
            if os.path.isdir(path):
                if not is_ignored_dir(name):
                    walk(path, (*above, mark))
            elif os.path.isfile(path):
                ext = ext_of(name)
                by = find_extractor(extractors, ext)
                if ext in allowed and st.st_size <= (by.max_file_bytes if by else MAX_FILE_BYTES):
                    found.append(Found(path, st.st_size, max(0, int(st.st_mtime // 1)), ext))

    walk(root, ())
    return sorted(found, key=lambda f: f.path)


def files(spark: SparkSession, root: str, extensions: Iterable[str] = (), extractors: Iterable[Extractor] = ()) -> DataFrame:
    """``discover`` as a table of ``path``, ``size``, ``mtime_secs``, ``ext``; no content is read."""
    return spark.createDataFrame([(f.path, f.size, f.mtime_secs, f.ext) for f in discover(root, extensions, extractors)], FILES)


def listed(spark: SparkSession, uri: str, extensions: Iterable[str] = ()) -> DataFrame:
    """As ``files`` for a folder given by URI: ``path`` is the file's URI, which ``uri`` repeats. No content is read.

    The same rules hold, but links are those of the file system, and what cannot be listed raises.
    """
    allowed = {*EXTENSIONS, *(e.lower().lstrip(".") for e in extensions)}
    base = uri.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", "length", "modificationTime")
    # Spark writes a local URI with one slash; paths under the root keep the root's own notation.
    tail = F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/+", "")
    under = F.substring(tail, len(re.sub("^[a-z][a-z0-9+.-]*:/+", "", base)) + 1, 1 << 30)
    folders = F.slice(F.split(under, "/"), 1, F.size(F.split(under, "/")) - 1)
    hidden = F.exists(folders, lambda f: f.startswith(".") | f.isin(*IGNORED_DIRS))
    found = rows.select(F.concat(F.lit(base), under).alias("path"), F.col("length").alias("size"), F.greatest(F.unix_seconds("modificationTime"), F.lit(0)).alias("mtime_secs"), hidden.alias("hidden"))
    found = found.withColumn("ext", column_ext(F.col("path"))).where(~F.col("hidden") & F.col("ext").isin(*allowed) & (F.col("size") <= MAX_FILE_BYTES))
    return found.select("path", "size", "mtime_secs", "ext", F.lit(uri).alias("uri"))


def read_listed(df: DataFrame) -> DataFrame:
    """As ``read_sections`` for rows of ``listed``: the files are read by Spark's source, only those that are asked for."""
    uri = df.select("uri").first()
    if uri is None:
        return df.sparkSession.createDataFrame([], "path string, content_hash string, status string, sections array<struct<text:string,page:int>>, error string")
    base = uri[0].rstrip("/") + "/"
    cut = len(re.sub("^[a-z][a-z0-9+.-]*:/+", "", base)) + 1
    rows = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri[0]).where(F.col("length") <= MAX_FILE_BYTES)
    named = rows.select(F.concat(F.lit(base), F.substring(F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/+", ""), cut, 1 << 30)).alias("path"), "content")
    asked = named.join(df.select("path"), "path", "left_semi")

    def run(batches):
        for batch in batches:
            out = [_read_one(p, raw, lambda raw=raw: [(decode(raw), None)]) for p, raw in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r)) for r in out], schema=_READ)

    return asked.mapInArrow(run, "path string, content_hash string, status string, sections array<struct<text:string,page:int>>, error string")


_READ = pa.schema([("path", pa.string()), ("content_hash", pa.string()), ("status", pa.string()), ("sections", pa.list_(pa.struct([("text", pa.string()), ("page", pa.int32())]))), ("error", pa.string())])


def _read_one(path: str, raw: bytes, extract: Callable[[], list[tuple[str, int | None]]]) -> tuple:
    digest = hashlib.sha256(raw).hexdigest()
    try:
        sections = extract()
    except NoText:
        sections = []
    except Exception as error:  # noqa: BLE001 - a user's extractor may raise anything
        return path, digest, "error", [], f"{type(error).__name__}: {error}"
    if not any(t and t.strip() for t, _ in sections):
        return path, digest, "empty", [], None
    return path, digest, "ok", [{"text": t, "page": p} for t, p in sections], None


def decode(raw: bytes) -> str:
    """UTF-8 text. Behind a byte order mark the bytes must be valid; without one, invalid ones become U+FFFD."""
    return raw[len(BOM) :].decode("utf-8", "strict") if raw.startswith(BOM) else raw.decode("utf-8", "replace")


def read_sections(df: DataFrame, extractors: Iterable[Extractor] = ()) -> DataFrame:
    """``path``, ``content_hash``, ``status``, ``sections`` and ``error`` of each file of a table with ``path`` and ``ext``.

    Status is ok, empty (readable without text) or error. A file's failure stays with the file: no task fails for it.
    """
    extractors = list(extractors)

    def one(path: str, ext: str | None) -> tuple:
        try:
            raw = Path(path).read_bytes()
        except OSError as error:
            return path, None, "error", [], f"{type(error).__name__}: {error}"
        by = find_extractor(extractors, ext)
        return _read_one(path, raw, (lambda: by.extract(path)) if by else lambda: [(decode(raw), None)])

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([one(p, e) for p, e in zip(frame["path"], frame["ext"])], columns=_READ.names)

    return df.select("path", "ext").mapInPandas(run, "path string, content_hash string, status string, sections array<struct<text:string,page:int>>, error string")
