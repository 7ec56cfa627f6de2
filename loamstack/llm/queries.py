"""The pN_ queries of the problems tagged llm, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.io import table
from loamstack.llm import boilerplate, encoding, markup, mix, neighbours, quality, scans, split, terms, tokenize


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pairs(neighbours.similar(table(spark, folder, "vecs")))


def p1_similar(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar(table(spark, folder, "vecs"), p=neighbours.Params(floor=-1.0))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split.split_tables(table(spark, folder, "sections"), table(spark, folder, "chunks"))
    return pieces.where("ordinal = 0").select("item_kind", "item_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_tables(table(spark, folder, "sections"), table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.most_distinctive(table(spark, folder, "chunks", "path", "chunk_key", "text"))


def p3_log_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_weights(table(spark, folder, "chunks", "path", "chunk_key", "text")).select("path", "term", F.col("log_entropy").alias("score"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair(table(spark, folder, "chunks", "chunk_key", "text")).where("garbled").select("chunk_key").distinct()


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair(table(spark, folder, "chunks", "chunk_key", "text")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_texts(table(spark, folder, "chunks", "chunk_key", "text")).where(F.size("kinds") > 0).select("chunk_key").distinct()


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_texts(table(spark, folder, "chunks", "chunk_key", "text")).distinct()


def p6_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.remove(table(spark, folder, "chunks", "chunk_key", "path", "text").distinct())


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.traces(table(spark, folder, "chunks", "chunk_key", "text", "path", "page")).select("chunk_key").distinct()


def p7_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repair(table(spark, folder, "chunks", "chunk_key", "text", "path", "page")).distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """What decoding makes of the ids of every document."""
    return tokenize.decode(tokenize.encode(table(spark, folder, "documents")))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p9_shards(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shards(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents", "doc_id", "text", "lang"), table(spark, folder, "common_words")).where("not prose").select("doc_id").distinct()


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents", "doc_id", "text", "lang"), table(spark, folder, "common_words"))


def p10_simple(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of p10_stats that SQL can express on whole texts."""
    rows = quality.describe(table(spark, folder, "documents", "doc_id", "text", "lang"), table(spark, folder, "common_words")).where("n_words is not null")
    return rows.select("doc_id", "n_words", *(F.round(c, 9).alias(c) for c in ("log_words", "mean_word_len", "symbol_ratio", "punct_lines")))


QUERIES = {f.__name__: f for f in (p1_found, p1_similar, p2_found, p2_pieces, p3_found, p3_log_entropy, p5_found, p5_restored, p6_found, p6_clean, p6_boilerplate, p7_found, p7_repaired, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_shards, p10_found, p10_stats, p10_simple)}
