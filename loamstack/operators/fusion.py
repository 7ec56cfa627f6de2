"""Fusing rankings and turning them into hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.text import display_score, first_lines

K = 60
DIGITS = 12


def rrf(rankings: list[DataFrame], top_k: int, keys: tuple[str, ...] = ("path", "ordinal")) -> DataFrame:
    """Reciprocal rank fusion: ``query_id``, ``keys``, ``score``, ``rank``.

    Each ranking has ``query_id``, ``keys`` and a 1-based ``rank``; a row's score is the sum of 1 / (60 + rank - 1) over
    the rankings it is in, rounded to 12 decimals. Ties go by the keys, so the result does not depend on the order of the
    rankings. Rankings may be empty.
    """
    parts = None
    for ranking in rankings:
        own = ranking.select("query_id", *keys, (F.lit(1.0) / (F.lit(K) + F.col("rank") - 1)).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    fused = parts.groupBy("query_id", *keys).agg(F.round(F.sum("part"), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *keys)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def hydrate(fused: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("path", "ordinal")) -> DataFrame:
    """Hits with text and page. The score shown is by place among all fused rows; a row without its chunk is dropped and
    the others keep their places. Text is read only here, for the few rows that are left."""
    sized = fused.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    hits = sized.withColumn("score", display_score(F.col("rank"), F.col("_n"))).drop("_n")
    return chunks.join(hits, list(keys), "inner").select("query_id", "path", F.col("ordinal").alias("chunk_index"), "score", "text", "page", "rank")


def render(hits: DataFrame, lines: int | None = 6) -> DataFrame:
    """``query_id``, ``rank`` and a printed form of each hit: a line with place, path, chunk and score, then its text.

    With ``lines`` the first lines of the text, indented; without, the whole text.
    """
    head = F.format_string("[%d] %s#chunk%d (score %.2f)", F.col("rank"), F.col("path"), F.col("chunk_index"), F.col("score"))
    body = F.col("text") if lines is None else F.regexp_replace(first_lines(F.col("text"), lines), r"(?m)^", "    ")
    return hits.select("query_id", "rank", F.concat(head, F.lit("\n"), body).alias("rendered"))
