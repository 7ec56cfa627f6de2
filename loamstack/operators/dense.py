"""Exact similarity search of stated queries over all vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.io import local

DIGITS = 6
#: Queries, and bytes of them, that may be broadcast; callers with more search in blocks of their queries.
MAX_QUERIES = 1 << 16
MAX_QUERY_BYTES = 256 << 20


def scan(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None, key: str = "chunk_key", vec: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``query_id``, ``key``, ``keep``, ``score`` and ``rank`` of the ``k`` rows of greatest dot product; ties go to the smaller key.

    Scores are computed in double precision and rounded to 6 decimals before ranking. Rows whose vector is null, of another
    length than the query, or whose score is not finite take no part. ``floor`` drops lower scores before the cut.
    Each batch of vectors is one matrix product and sends on its best k of every query; text is never read here.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null").limit(MAX_QUERIES + 1).toArrow()
    if rows.num_rows > MAX_QUERIES:
        raise ValueError("more than MAX_QUERIES queries; search in blocks of them")
    ids = rows.column(0).to_pylist()
    matrix = [np.asarray(v, dtype=float) for v in rows.column(1).to_pylist()]
    if sum(m.nbytes for m in matrix) > MAX_QUERY_BYTES:
        raise ValueError("the queries exceed MAX_QUERY_BYTES; search in blocks of them")
    widths = {len(m) for m in matrix}
    shared = spark.sparkContext.broadcast({w: ([i for i, m in enumerate(matrix) if len(m) == w], np.stack([m for m in matrix if len(m) == w])) for w in widths if w})

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for width, (which, asked) in shared.value.items():
                at = np.flatnonzero(lengths == width)
                if not len(at):
                    continue
                own = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                with np.errstate(all="ignore"):
                    found = np.round(asked @ own.T, DIGITS)
                found[~np.isfinite(found)] = -np.inf
                if floor is not None:
                    found[found < floor] = -np.inf
                for i, line in zip(which, found):
                    if len(line) > k:
                        least = np.partition(line, -k)[-k]
                        cols = np.flatnonzero(line >= least)
                    else:
                        cols = np.arange(len(line))
                    cols = cols[np.isfinite(line[cols])]
                    cols = cols[np.lexsort((keys[at[cols]], -line[cols]))][:k]
                    out[0].extend([i] * len(cols))
                    out[1].extend(at[cols].tolist())
                    out[2].extend(line[cols].tolist())
            rows = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), batch.column(0).take(rows), *(c.take(rows) for c in batch.columns[2:]), pa.array(out[2], pa.float64())], names=["_i", key, *keep, "score"])

    kept = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    near = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(vec), *keep).mapInArrow(run, f"_i int, `{key}` bigint{kept}, score double")
    best = Window.partitionBy("_i").orderBy(F.col("score").desc(), key)
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = queries.schema[query_id].dataType.simpleString()
    names = local(spark, enumerate(ids), f"_i int, query_id {kind}")
    return ranked.join(F.broadcast(names), "_i").select("query_id", key, *keep, "score", "rank")
