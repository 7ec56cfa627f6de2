"""The engine as its users see it: index, search, status, clear."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from loamstack.io import local
from loamstack.operators import search as searching
from loamstack.operators.embed import Embedder, HashedWords
from loamstack.operators.indexer import Options, Report, index_directory, index_one
from loamstack.operators.stats import by_extension
from loamstack.operators.store import Store
from loamstack.sources.corpus import Extractor


def default_folder() -> str:
    """Where the store lies unless told: LOAMSTACK_DATA, else the user's data folder, else the working folder."""
    for name, tail in (("LOAMSTACK_DATA", ""), ("XDG_DATA_HOME", "loamstack"), ("HOME", ".local/share/loamstack"), ("APPDATA", "loamstack")):
        if os.environ.get(name):
            return os.path.join(os.environ[name], tail) if tail else os.environ[name]
    return "."


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None, embedder: Embedder | None = None, extractors: Iterable[Extractor] = ()):
        self.spark = spark
        self.store = Store(spark, folder or default_folder())
        self.embedder = embedder or HashedWords()
        self.extractors = list(extractors)

    def index(self, path: str, extensions: Iterable[str] = (), options: Options = Options(), progress=None) -> Report:
        path = os.path.expanduser(path)
        return index_directory(self.store, path, extensions, options, self.extractors, self.embedder, progress)

    def index_file(self, path: str) -> int:
        return index_one(self.store, os.path.expanduser(path), self.extractors, self.embedder)

    def search(self, query: str, k: int = 5, min_similarity: float | None = None) -> DataFrame:
        return self.search_many([query], k, min_similarity)

    def search_many(self, queries: list[str], k: int = 5, min_similarity: float | None = None) -> DataFrame:
        """Hits of all queries in one plan; ``query_id`` is the place of the query in the list."""
        vectors = self.embedder.embed(queries).tolist() if queries else []
        asked = local(self.spark, [(i, q, v) for i, (q, v) in enumerate(zip(queries, vectors))], "query_id int, query string, embedding array<double>")
        return searching.hybrid_store(self.store, asked, k, min_similarity)

    def status(self) -> dict:
        row = self.store.stats().first()
        types = {r["ext"]: r["n"] for r in by_extension(self.store.docs()).collect()}
        return row.asDict() | {"by_extension": types, "data_dir": self.store.folder}

    def clear(self) -> None:
        self.store.clear()
