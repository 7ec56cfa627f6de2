"""Statistics of an index and of measured times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.text import stats_ext
from loamstack.session import cut_lineage


def totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: ``documents``, ``chunks``, ``total_source_bytes``; zeros for empty tables."""
    a = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_source_bytes"))
    b = chunks.agg(F.count("*").alias("chunks"))
    return a.crossJoin(b).select("documents", "chunks", "total_source_bytes")


def by_extension(docs: DataFrame) -> DataFrame:
    """``ext`` and ``n``, most frequent first, equal ones by name."""
    return docs.groupBy(stats_ext(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ext")


def latency(df: DataFrame, by: str, value: str, p: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Number, mean and percentiles by place of each group; null values take no part, a null group is one.

    Equal values are added up, then laid out in ranges of (group, value), so that a large group lies over many tasks. Each
    task counts on from what lies before its range; of that there is a row for each group and task.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    rows = cut_lineage(rows.repartitionByRange(by, value).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy(by, "_p").agg(F.sum("c").alias("size"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("size").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sizes.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), before.alias("before"), F.sum("size").over(group).alias("n"))
    upto = Window.partitionBy(by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.sum("c").over(upto)).join(known, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q"))).withColumn("upto", F.col("upto") + F.col("before"))
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * x), F.col("n") - 1), F.col(value))).alias(f"p{int(x * 100)}") for x in p]
    return ranked.groupBy(by).agg(F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"), *at)
