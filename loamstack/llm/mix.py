"""Mixing sources to target weights (problem 9).

Records are hashed into blocks, of which each source has as many as its part of all records asks for, and all decisions are
made on block sizes: how often each block is used, and which output shard gets which use. The one block of a source that is
used in part is cut again in the same way, and only its last part record by record. Shards come from a tree: a node's
blocks of each source are split between its two halves by a multivariate hypergeometric draw, so every shard gets its exact
number of blocks and, in expectation, the same mix, and no block is dealt twice. Only block sizes and the dealt table reach
the driver; both are bounded by blocks x repeats, whatever the corpus is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.io import local
from loamstack.llm.split import WHITE_SPACE
from loamstack.llm.tokenize import RANKS, TOKENIZERS, count_tokens
from loamstack.session import cut_lineage


#: Rows of the dealt table that are broadcast; a larger one is joined.
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class Params:
    """``blocks`` of all sources together, of at least ``records`` records; ``parts`` a block is cut into that is used in
    part; ``shards`` of the output (a power of 2); ``total`` tokens of the mix, by default as many as the repeats allow with
    every share exact; ``units``: the most uses of blocks that are dealt."""

    blocks: int = 65_536
    records: int = 16
    parts: int = 1_024
    shards: int = 64
    units: int = 5_000_000
    total: int | None = None
    seed: int = 11
    max_sources: int = 10_000


@dataclass
class Plan:
    """What was decided: tokens wanted of each source, uses of each block, the block used in part with the tokens wanted of
    it, its parts that are used whole, and the part that is cut, with the tokens wanted of that."""

    quota: dict[str, float] = field(default_factory=dict)
    uses: list[tuple[str, int, int]] = field(default_factory=list)
    cut: list[tuple[str, int, int]] = field(default_factory=list)
    whole: list[tuple[str, int, int]] = field(default_factory=list)
    last: list[tuple[str, int, int, int]] = field(default_factory=list)


def source_key(column: str):
    """A source without outer white space and case."""
    return F.lower(F.btrim(F.col(column), F.lit(WHITE_SPACE)))


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of each source's blocks for each shard; each half of a node gets half of its blocks, odd ones by lot."""
    if shards == 1:
        return counts[None, :]
    total = int(counts.sum())
    half = total // 2 + (int(rng.integers(2)) if total % 2 else 0)
    left = rng.multivariate_hypergeometric(counts, half) if total else np.zeros_like(counts)
    return np.concatenate([split_tree(left, shards // 2, rng), split_tree(counts - left, shards // 2, rng)])


def make_plan(sizes: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], p: Params) -> Plan:
    """``sizes``: tokens of each block of each source. ``targets``: share and most uses of a record by source.

    Sources without tokens cannot take part; the others share the mix in proportion to their targets.
    """
    rng = np.random.default_rng(p.seed)
    plan = Plan()
    have = {s: sum(sizes.get(s, {}).values()) for s in targets}
    ready = sorted(s for s in targets if have[s] > 0 and targets[s][0] > 0 and targets[s][1] > 0)
    shares = sum(targets[s][0] for s in ready)
    if not ready:
        return plan
    share = {s: targets[s][0] / shares for s in ready}
    total = min(targets[s][1] * have[s] / share[s] for s in ready) if p.total is None else p.total
    for s in ready:
        most = targets[s][1]
        quota = plan.quota[s] = min(share[s] * total, most * have[s])
        full = min(most, int(quota // have[s]))
        rest = quota - full * have[s]
        blocks = sorted(b for b, n in sizes[s].items() if n > 0)
        uses = dict.fromkeys(blocks, full)
        if full < most:
            for b in rng.permutation(blocks):
                b = int(b)
                if sizes[s][b] <= rest:
                    uses[b] += 1
                    rest -= sizes[s][b]
                else:
                    plan.cut.append((s, b, int(rest)))
                    break
        plan.uses += [(s, b, n) for b, n in uses.items()]
    return plan


def cut_again(plan: Plan, sizes: dict[tuple[str, int], dict[int, int]], p: Params) -> None:
    """Choose the parts of the cut blocks that fit, in random order, and the one that is cut in turn."""
    rng = np.random.default_rng(p.seed + 1)
    for s, b, rest in plan.cut:
        for part in rng.permutation(sorted(sizes.get((s, b), {}))):
            n = sizes[s, b][int(part)]
            if n > rest:
                plan.last.append((s, b, int(part), rest))
                break
            plan.whole.append((s, b, int(part)))
            rest -= n


def deal(plan: Plan, p: Params) -> list[tuple[str, int, int, int, int]]:
    """(source, block, part, copy, shard) of every use of a block (part -1) and of the parts of cut ones."""
    rng = np.random.default_rng(p.seed + 2)
    uses: dict[str, dict[int, int]] = {}
    for s, b, n in plan.uses:
        uses.setdefault(s, {})[b] = n
    if sum(n for _, _, n in plan.uses) > p.units:
        raise ValueError(f"more than {p.units} uses of blocks; use fewer blocks")
    blocks: dict[str, list[tuple[int, int, int]]] = {}
    for s, own in sorted(uses.items()):
        # Copies lie one behind the other over all blocks, each in an order of its own, so that they end up far apart.
        blocks[s] = [(int(b), -1, copy) for copy in range(max(own.values(), default=0)) for b in rng.permutation([b for b, n in own.items() if n > copy])]
    parts: dict[str, list[tuple[int, int, int]]] = {}
    for s, b, part in [*plan.whole, *(x[:3] for x in plan.last)]:
        parts.setdefault(s, []).append((b, part, uses[s][b]))
    dealt = []
    for draws in (blocks, parts):
        sources = sorted(draws)
        at = dict.fromkeys(sources, 0)
        for shard, row in enumerate(split_tree(np.array([len(draws[s]) for s in sources], dtype=np.int64), p.shards, rng) if sources else ()):
            for s, n in zip(sources, row):
                dealt += [(s, *unit, shard) for unit in draws[s][at[s] : at[s] + int(n)]]
                at[s] += int(n)
    return dealt


def _counted(docs: DataFrame, key: str, text: str, source: str, p: Params, folder: str, ranks: str) -> DataFrame:
    """Tokens of each record, computed once and kept in the shared folder."""
    # Of several rows of a record, the one with most tokens counts.
    rows = count_tokens(docs.where(F.col(key).isNotNull()), key, text, (source,), folder, ranks)
    one = rows.groupBy(key).agg(F.max(F.struct("n_tokens", source_key(source).alias("source"))).alias("x"))
    mark = F.xxhash64(F.lit(p.seed), F.col(key))
    return cut_lineage(one.select(key, F.col("x.source").alias("source"), F.col("x.n_tokens").alias("n_tokens"), mark.alias("mark")))


def _planned(counted: DataFrame, targets: DataFrame, p: Params) -> tuple[Plan, dict[str, tuple[float, int]], DataFrame]:
    """The plan, the targets by source, and the records with their ``block`` and ``part``."""
    spark = counted.sparkSession
    rows = targets.where("source is not null").groupBy(source_key("source").alias("s")).agg(F.max("target_share"), F.max("max_repeats")).limit(p.max_sources + 1).collect()
    if len(rows) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources have targets")
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}
    # Tables of at most max_sources rows here, and of no more rows than blocks or parts below.
    asked = local(spark, [(s,) for s in wanted], "source string")
    records = dict(counted.where("n_tokens > 0").join(F.broadcast(asked), "source").groupBy("source").count().collect())
    every = sum(records.values())
    blocks = local(spark, [(s, max(1, min(math.ceil(n / p.records), p.blocks * n // every))) for s, n in records.items()], "source string, _blocks bigint")
    placed = counted.join(F.broadcast(blocks), "source", "left").select(
        *counted.columns, F.pmod("mark", F.coalesce("_blocks", F.lit(1))).cast("int").alias("block"), F.pmod(F.xxhash64(F.lit(p.seed), "mark"), F.lit(p.parts)).cast("int").alias("part")
    )
    known = placed.where("n_tokens > 0").join(F.broadcast(asked), "source")
    sizes: dict[str, dict[int, int]] = {}
    for s, b, n in known.groupBy("source", "block").agg(F.sum("n_tokens")).collect():
        sizes.setdefault(s, {})[b] = n
    plan = make_plan(sizes, wanted, p)
    if plan.cut:
        cut = local(spark, [x[:2] for x in plan.cut], "source string, block int")
        parts: dict[tuple[str, int], dict[int, int]] = {}
        for s, b, part, n in known.join(F.broadcast(cut), ["source", "block"]).groupBy("source", "block", "part").agg(F.sum("n_tokens")).collect():
            parts.setdefault((s, b), {})[part] = n
        cut_again(plan, parts, p)
    return plan, wanted, placed


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: Params = Params(), folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """How often each record is used: ``key``, ``source``, ``n_tokens``, ``uses``, and its source's ``target_share`` and ``actual_share``.

    Records without tokens (null or empty texts) and those of sources without a target, or of a null source, have 0 uses.
    Sizes are exact to less than one record a source: the last part of a block is cut by a running sum over its records alone.
    Repeated rows of a key count once. An empty table gives no rows, empty targets no uses.
    """
    spark = docs.sparkSession
    counted = _counted(docs, key, text, source, p, folder, ranks)
    plan, wanted, placed = _planned(counted, targets, p)
    used = _used(placed, plan, key)
    reached = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens")).where("tokens > 0")
    whole = reached.agg(F.sum("tokens").alias("whole"))
    shares = reached.crossJoin(F.broadcast(whole)).select("source", (F.col("tokens") / F.col("whole")).alias("actual_share"))
    target = local(spark, [(s, w[0]) for s, w in wanted.items()], "source string, target_share double")
    # One row a source with a target, of which there are at most max_sources.
    table = target.join(shares, "source", "left").select("source", "target_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"))
    return used.join(F.broadcast(table), "source", "left").select(key, "source", "n_tokens", "uses", "target_share", "actual_share")


def _used(placed: DataFrame, plan: Plan, key: str) -> DataFrame:
    """``uses`` of each record, and the ``base`` of them that its whole block has."""
    spark = placed.sparkSession
    uses = local(spark, plan.uses, "source string, block int, base int")
    whole = local(spark, [(*x, 1) for x in plan.whole], "source string, block int, part int, more int")
    last = local(spark, plan.last, "source string, block int, part int, rest bigint")
    rows = placed.join(F.broadcast(uses), ["source", "block"], "left").join(F.broadcast(whole), ["source", "block", "part"], "left").join(F.broadcast(last), ["source", "block", "part"], "left")
    # The one part of a source that is used in part: its first records by hash that fit what is left.
    inside = Window.partitionBy("source", "block", "part").orderBy("mark", key)
    fits = F.sum("n_tokens").over(inside) <= F.col("rest")
    cut = rows.where("rest is not null and n_tokens > 0").withColumn("more", F.when(fits, 1).otherwise(0))
    every = rows.where("rest is null or n_tokens <= 0").unionByName(cut)
    base, more = F.coalesce("base", F.lit(0)), F.coalesce("more", F.lit(0))
    return every.select(key, "source", "block", "part", "mark", "n_tokens", F.when(F.col("n_tokens") > 0, base + more).otherwise(0).alias("uses"), base.alias("base"))


def shards(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: Params = Params(), folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """One row for each use of a record: ``key``, ``copy``, ``shard`` and ``place``, its order in the shard.

    Every shard holds the same number of blocks, give or take one a level of the tree, and of parts of cut blocks as well.
    """
    spark = docs.sparkSession
    counted = _counted(docs, key, text, source, p, folder, ranks)
    plan, _, placed = _planned(counted, targets, p)
    used = _used(placed, plan, key).where("uses > 0")
    units = deal(plan, p)
    dealt = local(spark, units, "source string, block int, part int, copy int, shard int")
    small = F.broadcast if len(units) <= MOST_BROADCAST else lambda df: df
    whole = used.join(small(dealt.where("part < 0").drop("part")), ["source", "block"]).select(key, "copy", "shard")
    part = used.where("uses > base").join(small(dealt.where("part >= 0")), ["source", "block", "part"]).select(key, "copy", "shard")
    return whole.unionByName(part).withColumn("place", F.xxhash64(F.lit(p.seed), "shard", "copy", key))


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: Params = Params(), folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """A row for each source with a target: target and actual share, tokens and records of the mix, and the most uses."""
    spark = docs.sparkSession
    counted = _counted(docs, key, text, source, p, folder, ranks)
    plan, wanted, placed = _planned(counted, targets, p)
    used = _used(placed, plan, key).where("uses > 0").groupBy("source").agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.sum("uses").alias("records"), F.max("uses").alias("most_uses")
    )
    target = local(spark, [(s, w[0]) for s, w in wanted.items()], "source string, target_share double")
    whole = used.agg(F.sum("tokens").alias("whole"))
    out = target.join(used, "source", "left").crossJoin(F.broadcast(whole))
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_uses")))
