"""Giving each text the rows of a table that belong to its words."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that are broadcast; with more, each text gets its own by a join.
BROADCAST_ROWS = 300_000
_SALTS = 16


def with_own(src: DataFrame, text: str, table: DataFrame, words: Callable[[str], Iterable[str]], most: int = BROADCAST_ROWS) -> tuple[DataFrame, Broadcast | None]:
    """``src`` with ``_own``, the rows of ``table`` (a ``word`` and more) whose word is among those of the text, and None; or,
    if the table has at most ``most`` rows, ``src`` with a null ``_own`` and all rows broadcast, as {word: [the rest, ...]}.

    ``table`` must be at hand. Texts go by their hash: of two that share one, each gets what belongs to either, which does
    no harm to a look-up by word. A word of very many texts is spread over several tasks.
    """
    rest = [c for c in table.columns if c != "word"]
    kind = "array<" + table.select(F.struct("word", *rest).alias("x")).schema["x"].dataType.simpleString() + ">"
    rows = table.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        known: dict[str, list[tuple]] = {}
        for word, *values in zip(*(rows.column(c).to_pylist() for c in ("word", *rest))):
            known.setdefault(word, []).append(tuple(values))
        return src.withColumn("_own", F.lit(None).cast(kind)), src.sparkSession.sparkContext.broadcast(known)

    def spread(batches):
        for batch in batches:
            found = [(h, w) for h, t in zip(*(c.to_pylist() for c in batch.columns)) if t for w in set(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["_h", "word"])

    hashed = src.withColumn("_h", F.xxhash64(text))
    asked = hashed.select("_h", text).mapInArrow(spread, "_h bigint, word string").withColumn("_s", F.pmod(F.col("_h"), F.lit(_SALTS)).cast("int"))
    copies = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = asked.join(copies, ["word", "_s"]).groupBy("_h").agg(F.collect_set(F.struct("word", *rest)).alias("_own"))
    return hashed.join(own, "_h", "left").drop("_h"), None


def by_word(own: list[dict] | None) -> dict[str, list[tuple]]:
    """What ``with_own`` gave a text, in the form of what it broadcasts."""
    known: dict[str, list[tuple]] = {}
    for row in own or ():
        known.setdefault(row["word"], []).append(tuple(v for k, v in row.items() if k != "word"))
    return known
