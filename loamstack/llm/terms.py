"""How distinctive a term is of a record (problem 3): log-entropy weighting by two SQL aggregations.

The first adds up what each record has of each term, the second what each term has over all records. A term that every
record has would put all its rows in one task; so rows lie by term and by one of ``SALTS`` classes of records, and the
second aggregation goes first over a term's rows of a class, then over its classes, and comes back to the rows by both.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

TERM = "[a-z0-9]{4,}"
#: Classes of records over which the rows of a term are spread.
SALTS = 32


def _counts(batches, names: list[str]):
    """Pieces that hold a term, and its occurrences, for each record and run of pieces; rows come sorted by these and by piece."""
    find = re.compile(TERM).findall
    out: list[list] = [[], [], [], []]
    group, piece, texts, have = None, None, set(), set()
    pieces: Counter = Counter()
    tf: Counter = Counter()

    def close():
        if tf:
            out[0] += [group[0]] * len(tf)
            out[1] += tf
            out[2] += map(pieces.__getitem__, tf)
            out[3] += tf.values()
            pieces.clear()
            tf.clear()

    def made():
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        for c in out:
            c.clear()
        return batch

    kinds = None
    for batch in batches:
        kinds = kinds or [batch.schema.types[0], pa.string(), pa.int64(), pa.int64()]
        for r, b, p, t in zip(*(c.to_pylist() for c in batch.columns)):
            if (r, b) != group:
                close()
                group, piece = (r, b), None
                if len(out[1]) > 50_000:
                    yield made()
            if piece is None or p != piece[0]:
                piece, texts, have = (p,), set(), set()
            if t in texts:
                continue
            texts.add(t)
            found = find(t.lower())
            tf.update(found)
            new = set(found) - have
            pieces.update(new)
            have |= new
    close()
    if kinds:
        yield made()


def term_weights(df: DataFrame, record: str = "path", piece: str = "chunk_key", text: str = "text") -> DataFrame:
    """Each term of each record: ``pieces`` that hold it, ``tf``, ``records`` that hold it, ``total`` records, and two weights.

    ``log_entropy`` is ln(1 + tf) x (1 - H / ln total), H the entropy of the term's spread over the records, 1 where there
    is but one record. ``rarity`` is pieces x ln(total / records). Both are rounded to 9 decimals.

    Terms are runs of at least 4 ASCII letters and digits of the lower-cased text. Repeated rows count once; a piece that
    occurs with several texts holds the terms of all. Null texts hold no term, but their record counts in ``total``; null
    records take no part. Neither a record of many pieces nor a term of many records is gathered in one task.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("_r"), F.col(piece).alias("_p"), F.col(text).alias("_t"))
    total = rows.agg(F.countDistinct("_r").cast("double").alias("total"))
    # Pieces with near keys go to one task, which puts most pieces of a record together without gathering a large record.
    near = F.floor(F.col("_p") / 512) if isinstance(df.schema[piece].dataType, NumericType) else F.pmod(F.xxhash64("_p"), F.lit(64))
    sorted_ = rows.where("_t is not null").select("_r", near.alias("_b"), "_p", "_t").repartition("_r", "_b").sortWithinPartitions("_r", "_b", "_p")
    # Added up where the pieces are, so that a term is sent once for each record and 512 of its pieces at most.
    kind = df.schema[record].dataType.simpleString()
    there = sorted_.mapInArrow(lambda batches: _counts(batches, ["_r", "term", "pieces", "tf"]), f"_r {kind}, term string, pieces bigint, tf bigint")
    # The filter is the one the join would put on one of the two readers of these rows only; with it they share an exchange.
    salted = there.withColumn("_s", F.pmod(F.xxhash64("_r"), F.lit(SALTS)).cast("int")).where("term is not null and _s is not null and _r is not null").repartition("term", "_s")
    local = salted.groupBy("term", "_s", "_r").agg(F.sum("pieces").alias("pieces"), F.sum("tf").alias("tf"))
    # It counts by a column it could do without, so that both readers of the rows need the same and share one exchange.
    part = local.groupBy("term", "_s").agg(F.count(F.when(F.col("pieces") > 0, 1)).alias("records"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log("tf")).alias("s"))
    whole = Window.partitionBy("term")
    spread = part.select("term", "_s", *(F.sum(c).over(whole).alias(c) for c in ("records", "gf", "s")))
    entropy = F.log("gf") - F.col("s") / F.col("gf")
    norm = F.when(F.col("total") > 1, entropy / F.log("total")).otherwise(0.0)
    return (
        local.join(spread.hint("shuffle_hash"), ["term", "_s"]).crossJoin(F.broadcast(total))
        .select(
            F.col("_r").alias(record), "term", "pieces", "tf", "records", F.col("total").cast("bigint").alias("total"),
            F.round(F.log1p("tf") * F.greatest(1 - norm, F.lit(0.0)), 9).alias("log_entropy"),
            F.round(F.col("pieces") * F.log(F.col("total") / F.col("records")), 9).alias("rarity"),
        )
    )


def most_distinctive(df: DataFrame, weight: str = "rarity", least_pieces: int = 4, record: str = "path", piece: str = "chunk_key", text: str = "text") -> DataFrame:
    """The term of greatest weight of each record with ``least_pieces`` pieces; ties go to the term first in code-point order."""
    large = df.where(F.col(record).isNotNull()).groupBy(record).agg(F.countDistinct(piece).alias("_n")).where(F.col("_n") >= least_pieces).select(record)
    best = term_weights(df, record, piece, text).where(F.col(weight) > 0).groupBy(record).agg(F.min(F.struct(-F.col(weight), "term")).alias("best"))
    return best.join(large, record, "left_semi").select(record, F.col("best.term").alias("term"))
