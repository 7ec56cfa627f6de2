"""Keyword search by BM25 over one or more text fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.text import query_terms, tokens

K1 = 1.2
B = 0.75
DIGITS = 9


def analysed(chunks: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``key``, ``field`` and ``terms`` of every row and field (name to column). A null field has no terms."""
    each = [F.struct(F.lit(name).alias("field"), F.coalesce(tokens(F.col(column)), F.array().cast("array<string>")).alias("terms")) for name, column in fields.items()]
    return chunks.select(key, F.inline(F.array(*each)))


def postings(chunks: DataFrame, key: str = "chunk_key", fields: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``field``, ``term``, ``key``, the columns ``keep``, ``tf`` and ``len``, the number of terms of the row's field."""
    fields = fields or {"text": "text"}
    base = analysed(chunks.select(F.struct(key, *keep).alias("_row"), *fields.values()), "_row", fields)
    each = base.select("_row", "field", F.size("terms").cast("bigint").alias("len"), F.explode("terms").alias("term"))
    return each.groupBy("field", "term", "_row", "len").agg(F.count("*").alias("tf")).select("field", "term", "_row.*", "tf", "len")


def field_len(chunks: DataFrame, key: str = "chunk_key", fields: dict[str, str] | None = None) -> DataFrame:
    """``field``, ``key`` and the number of terms ``len``; rows without terms have 0."""
    return analysed(chunks, key, fields or {"text": "text"}).select("field", key, F.size("terms").cast("bigint").alias("len"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """``field``, its number of rows ``n`` and their mean length ``avg``."""
    return lengths.groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"))


def doc_freq(posted: DataFrame) -> DataFrame:
    """Rows that hold each term of each field."""
    # It reads tf so that it needs what scoring needs, and both can read one exchange.
    return posted.groupBy("field", "term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))


def asked_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``query_id``, ``term`` and how often the query has it. Blank queries and those of stopwords alone have no rows."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(query_terms(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def score(posted: DataFrame, stats: DataFrame, queries: DataFrame, key: str = "chunk_key", query_id: str = "query_id", query: str = "query", keep: tuple[str, ...] = ()) -> DataFrame:
    """``query_id``, ``key``, ``keep`` and ``score`` (9 decimals) of all rows that hold a term of the query, summed over terms and fields.

    ``posted`` and ``stats`` are as ``postings`` and ``field_stats`` give them, and statistics are those of all rows. Only
    postings of asked terms leave the scan's stage: the join with the queries' terms comes before all else. The query
    side is broadcast by Spark if its size allows and shuffled otherwise.
    """
    asked = asked_terms(queries, query_id, query)
    return _weighted(posted.join(asked.select("term").distinct(), "term", "left_semi"), stats, asked, (key, *keep))


def score_rows(chunks: DataFrame, queries: DataFrame, key: str = "chunk_key", fields: dict[str, str] | None = None, query_id: str = "query_id", query: str = "query", keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``score`` for rows without stored postings, in one pass over the text.

    Each row and field gives the asked terms it has and one mark without a term. Marks of equal length are added up where
    they are; statistics come from them, and all that follows reads the one exchange.
    """
    asked = asked_terms(queries, query_id, query)
    fields = fields or {"text": "text"}
    base = analysed(chunks.select(F.struct(key, *keep).alias("_row"), *fields.values()), "_row", fields).select("_row", "field", F.size("terms").cast("bigint").alias("len"), "terms")
    each = base.select("_row", "field", "len", F.explode(F.array_append("terms", F.lit(None).cast("string"))).alias("term"))
    wanted = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    kept = each.join(wanted, "term", "left").where("term is null or _asked").select("field", "term", F.when(F.col("term").isNotNull(), F.col("_row")).alias("_row"), "len")
    met = kept.groupBy("field", "term", "_row", "len").agg(F.count("*").alias("tf"))
    marks = met.where("term is null")
    stats = marks.groupBy("field").agg(F.sum("tf").cast("double").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg"))
    hits = met.where("term is not null").select("field", "term", "_row.*", "len", "tf")
    return _weighted(hits, stats, asked, (key, *keep))


def _weighted(met: DataFrame, stats: DataFrame, asked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return weigh(met, doc_freq(met), stats, asked, keys)


def weigh(met: DataFrame, freq: DataFrame, stats: DataFrame, asked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Scores from postings of asked terms, the number of rows that hold each (``freq``), ``stats`` and ``asked`` terms."""
    tf = F.col("tf").cast("double")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # A row for each asked term and field, and as many statistics as there are fields.
    known = freq.join(F.broadcast(stats), "field").join(asked, "term")
    return met.join(known, ["field", "term"]).groupBy("query_id", *keys).agg(F.round(F.sum(F.col("qtf") * weight), DIGITS).alias("score"))


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` best of each query with their ``rank`` (1-based); ties go by the given columns. Cut before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_key", fields: dict[str, str] | None = None, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The ``k`` best rows of each query by BM25, without stored postings."""
    return top(score_rows(chunks, queries, key, fields, query_id, query), k, key)
