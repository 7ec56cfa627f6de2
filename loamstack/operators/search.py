"""Hybrid search: exact dense scan and BM25, fused by reciprocal rank."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.text import query_terms
from loamstack.io import local
from loamstack.operators import bm25, dense, fusion
from loamstack.operators.store import Store

#: Candidates each side offers for a hit asked for.
BUDGET = 4
#: Terms and hits that are given to a scan as a filter; more are joined.
PUSHED_TERMS = 1_000
PUSHED_HITS = 10_000


def clamp_k(k: int | None) -> int:
    """Number of hits the service gives: 5 by default, 1 to 25."""
    return max(1, min(25, 5 if k is None else k))


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, min_similarity: float | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """Hits of each query: ``query_id``, ``path``, ``chunk_index``, ``score``, ``text``, ``page``, ``rank``; over tables without an index.

    ``queries`` has ``query_id``, ``query`` and ``embedding``; a query with a null embedding is answered by keywords alone,
    one without terms by vectors alone. ``min_similarity`` holds for the dense side only. Each side offers 4 x k
    candidates, and text is joined after the fusion, to k rows a query. One lazy plan, whatever the number of queries.
    """
    near = dense.scan(vectors, queries, BUDGET * k, min_similarity).join(chunks.select("chunk_key", "path", "ordinal"), "chunk_key")
    scored = bm25.score_rows(chunks, queries, fields=fields or {"text": "text", "path": "path"}, keep=("path", "ordinal"))
    fused = fusion.rrf([near, bm25.top(scored, BUDGET * k, "path", "ordinal")], k)
    return fusion.hydrate(fused, chunks.select("path", "ordinal", "text", "page"))


def candidates(store: Store, queries: DataFrame, k: int = 5, min_similarity: float | None = None) -> DataFrame:
    """The ``k`` best of each query in a store, without their text: ``query_id``, ``path``, ``ordinal``, ``chunk_key``, ``score``, ``rank``.

    Neither side reads text: one scans vectors, the other the postings of the asked terms. The two run side by side, and
    what they offer, 4 x k rows a query, passes through the driver; beyond ``PUSHED_HITS`` rows all stays one lazy plan.
    """
    keep = ("path", "ordinal")
    asked = queries.select("query_id", query_terms(F.col("query")).alias("terms")).limit(PUSHED_HITS + 1).collect()
    few = len(asked) * BUDGET * k <= PUSHED_HITS
    near = dense.scan(store.table("vectors"), queries, BUDGET * k, min_similarity, keep=keep)
    terms = {t for r in asked for t in r["terms"] or ()} if few else set()
    posted = store.table("postings")
    if few and len(terms) <= PUSHED_TERMS:
        scored = lambda: _scored_few(store, posted, asked, terms, queries.schema["query_id"].dataType.simpleString(), keep)
    else:
        scored = lambda: bm25.score(posted, store.field_stats(), queries, keep=keep)
    columns = ("query_id", *keep, "chunk_key", "rank")
    words = lambda: bm25.top(scored(), BUDGET * k, *keep).select(*columns)
    sides = [near.select(*columns), words()] if not few else _side_by_side(store.spark, lambda: near.select(*columns), words)
    return fusion.rrf(sides, k, (*keep, "chunk_key"))


def _scored_few(store: Store, posted: DataFrame, asked: list, terms: set[str], kind: str, keep: tuple[str, ...]) -> DataFrame:
    """BM25 of queries with few terms: as a filter of the scan these skip the row groups of others, and how many rows hold
    each is asked first, so that the scores need one exchange."""
    rows = posted.where(F.col("term").isin(*sorted(terms)) if terms else F.lit(False))
    times = [(r["query_id"], t, n) for r in asked for t, n in Counter(r["terms"] or ()).items()]
    wanted = local(store.spark, times, f"query_id {kind}, term string, qtf bigint")
    known = local(store.spark, bm25.doc_freq(rows).collect() if terms else [], "field string, term string, df bigint")
    return bm25.weigh(rows, known, store.field_stats(), wanted, ("chunk_key", *keep))


def _side_by_side(spark, *plans) -> list[DataFrame]:
    """The rows of small results that are computed at the same time, as local tables."""

    def run(plan) -> tuple:
        df = plan()
        return df.collect(), df.schema

    with ThreadPoolExecutor(len(plans)) as pool:
        return [local(spark, *done) for done in pool.map(run, plans)]


def hybrid_store(store: Store, queries: DataFrame, k: int = 5, min_similarity: float | None = None) -> DataFrame:
    """As ``hybrid`` over a store's index. What is found, k rows a query, passes through the driver, so that text is read
    by a scan that is filtered by chunk keys, in which the files are ordered. Beyond ``PUSHED_HITS`` hits it is joined."""
    fused = candidates(store, queries, k, min_similarity)
    rows = fused.limit(PUSHED_HITS + 1).collect()
    chunks = store.table("chunks")
    if len(rows) <= PUSHED_HITS:
        rows.sort(key=lambda r: r["chunk_key"])
        fused = local(store.spark, rows, fused.schema)
        chunks = chunks.where(F.col("chunk_key").isin([r["chunk_key"] for r in rows]))
    return fusion.hydrate(fused.drop("chunk_key"), chunks.select("path", "ordinal", "text", "page"))


def by_ordinal(chunks: DataFrame, path: str, ordinal: int) -> DataFrame:
    """The chunk of a path and ordinal: ``path``, ``text``, ``page``; no row if there is none."""
    return chunks.where((F.col("path") == path) & (F.col("ordinal") == ordinal)).select("path", "text", "page")


def by_key(chunks: DataFrame, key: int) -> DataFrame:
    return chunks.where(F.col("chunk_key") == key)
