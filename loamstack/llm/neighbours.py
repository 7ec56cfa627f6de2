"""Most similar vectors for every vector (problem 1).

A bounded sample gives a neighbour graph; the graph is cut into parts of equal size that keep neighbours together; a
linear classifier learns from the parts of a vector's neighbours which parts to look in. Every vector is then a member of
its most probable part and a visitor of the next ones, and each part is compared within itself by matrix products.

One sample can tell only so many parts apart. A part of more than ``deep`` members is therefore cut again: a sample of its
own members gives it a router of its own, fitted by one task a part, and its members and visitors go on to its leaves.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.io import local
from loamstack.session import cut_lineage


@dataclass(frozen=True)
class Params:
    """``sample``: the most vectors the router is fitted on. ``part``: members a part should have. ``probes``: parts a
    vector is looked up in, and leaves of each such part. ``block``: members compared at once; larger parts are worked through
    block by block. ``split``: members beyond which the queries of a part are spread over several tasks. ``seen``: sampled
    vectors a part needs to be told apart, so a router has at most ``sample / seen`` parts. ``deep``: members beyond
    which a part gets a router of its own; so up to some 10^9 vectors no leaf is to hold more than that many."""

    dims: int = 384
    k: int = 5
    floor: float = 0.57
    sample: int = 16_384
    graph_k: int = 12
    part: int = 900
    probes: int = 2
    block: int = 4_096
    split: int = 6_000
    seen: int = 16
    deep: int = 24_000
    rounds: int = 6
    seed: int = 7


# ---- the router -----------------------------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` nearest other rows by dot product, block by block."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        out[at : at + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut the graph into ``parts`` (a power of 2) of equal size.

    Each level halves every part: a value per node is smoothed over the edges inside the part, so that it varies slowly
    along the graph, and the part is cut at the median. Afterwards nodes move to the part most of their neighbours are
    in, as long as no part exceeds its share by a tenth.
    """
    n = len(graph)
    label = np.zeros(n, dtype=np.int64)
    for level in range(int(math.log2(parts))):
        value = x @ rng.standard_normal(x.shape[1]).astype(x.dtype)
        inside = label[graph] == label[:, None]
        degree = np.maximum(inside.sum(1), 1)
        for _ in range(12):
            value = 0.5 * value + 0.5 * (value[graph] * inside).sum(1) / degree
            size = np.maximum(np.bincount(label, minlength=1 << level), 1)
            value -= (np.bincount(label, value, 1 << level) / size)[label]
            value /= np.sqrt(np.bincount(label, value**2, 1 << level) / size)[label] + 1e-12
        order = np.lexsort((value, label))
        first = np.searchsorted(label[order], np.arange(1 << level))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - first[label[order]]
        half = (np.bincount(label, minlength=1 << level) + 1) // 2
        label = label * 2 + (rank >= half[label])
    most = math.ceil(1.1 * n / parts)
    size = np.bincount(label, minlength=parts)
    for _ in range(3):
        for node in rng.permutation(n):
            around = label[graph[node]]
            best = np.bincount(around).argmax()
            own = label[node]
            if best != own and size[best] < most and (around == best).sum() > (around == own).sum():
                size[own] -= 1
                size[best] += 1
                label[node] = best
    return label


def fit_router(x: np.ndarray, p: Params, total: int) -> np.ndarray:
    """Weights of the classifier, one column a part, from sampled unit vectors ``x`` of ``total`` rows."""
    parts = 1 << max(0, math.ceil(math.log2(max(total, 1) / p.part)))
    while parts > 1 and parts * p.seen > len(x):
        parts //= 2
    if parts == 1:
        return np.zeros((p.dims, 1), dtype=np.float32)
    rng = np.random.default_rng(p.seed)
    graph = neighbour_graph(x, p.graph_k)
    label = balanced_parts(graph, x, parts, rng)
    weights = np.zeros((p.dims, parts), dtype=np.float32)
    np.add.at(weights.T, label, x)
    weights *= 8 / np.maximum(np.linalg.norm(weights, axis=0), 1e-9)
    # Target of a vector: the parts of its neighbours and, as much again, its own.
    moment = np.zeros_like(weights)
    for step in range(p.rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            rows = order[at : at + 512]
            z = x[rows] @ weights
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            near = label[graph[rows]]
            np.subtract.at(z, (np.arange(len(rows))[:, None], near), 0.5 / near.shape[1])
            z[np.arange(len(rows)), label[rows]] -= 0.5
            moment = 0.8 * moment + x[rows].T @ z
            weights -= (1.5 / (1 + step)) * moment / len(rows) * 10
    return weights


# ---- packing --------------------------------------------------------------------------------------------------------


def pack(v: np.ndarray) -> bytes:
    """A float32 vector without loss: as half floats where these hold it exactly."""
    half = v.astype(np.float16)
    return half.tobytes() if np.array_equal(half.astype(np.float32), v) else v.tobytes()


def unpack(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float16 if len(raw) == 2 * dims else np.float32).astype(np.float64)


def _valid(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and float32 rows of the vectors that take part."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    index = np.flatnonzero(lengths == dims)
    if not len(index):
        return index, np.empty((0, dims), dtype=np.float32)
    taken = column.take(pa.array(index))
    rows = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.isfinite(rows).all(1) & rows.any(1)
    return index[good], rows[good]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


#: Rows beyond which a class of equal vectors is not brought together.
HOT = 1_000_000

# ---- the join -------------------------------------------------------------------------------------------------------


def _units(entries: list, dims: int) -> np.ndarray:
    return _unit(np.stack([unpack(raw, dims) for _, raw in entries]))


def _search(members: list, queries: list, p: Params):
    """Best ``k`` of ``members`` for each of ``queries``: rows of (query key, other key, similarity).

    An entry is (keys, packed vector) of one class of equal vectors, keys ascending and at most k + 1 of them. Beyond
    those no key of a class can be among the k best of anything, since its smaller ones tie with it and come first.
    """
    base = _units(members, p.dims)
    fast = base.astype(np.float32)
    width = min(p.k + 8, len(members))
    for at in range(0, len(queries), 1024):
        part = queries[at : at + 1024]
        exact = _units(part, p.dims)
        s = exact.astype(np.float32) @ fast.T
        near = np.argpartition(-s, width - 1, axis=1)[:, :width]
        low = np.take_along_axis(s, near, 1).min(1)
        for i, (keys, _) in enumerate(part):
            cols = near[i]
            fine = np.round(base[cols] @ exact[i], 6)
            if width < len(members) and low[i] >= max(p.floor, np.partition(fine, -p.k - 1)[-p.k - 1]) - 1e-5:
                # The cut fell among equals: look at all that are as good.
                cols = np.flatnonzero(s[i] >= low[i] - 1e-5)
                fine = np.round(base[cols] @ exact[i], 6)
            good = fine >= p.floor
            if not good.any():
                continue
            found = sorted((-sim, other) for c, sim in zip(cols[good], fine[good]) for other in members[c][0])
            for key in keys:
                n = 0
                for sim, other in found:
                    if other != key:
                        yield key, other, -sim
                        n += 1
                        if n == p.k:
                            break


_ROUTED = "part int, leaf int, slice int, role tinyint, keys array<bigint>, vec binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.list_(pa.int64()), pa.binary()]


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], names=["part", "leaf", "slice", "role", "keys", "vec"])


def _probed(unit: np.ndarray, router: np.ndarray, probes: int) -> np.ndarray:
    """The most probable parts of each vector, the best first."""
    z = unit @ router
    probes = min(probes, z.shape[1])
    top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1)


def _mark(unit: np.ndarray) -> int:
    return int.from_bytes(unit.tobytes()[:4], "little")


def _spread(cols: list[list], part: int, leaf: int, slices: int, mark: int, home: bool, keys: list, raw: bytes) -> None:
    """A member goes to every slice of its home, and is asked for in one; a visitor is asked for in one."""
    own = mark % slices
    for slice_ in range(slices) if home else (own,):
        for col, value in zip(cols, (part, leaf, slice_, (2 if slice_ == own else 1) if home else 0, keys, raw)):
            col.append(value)


def _sampled(src: DataFrame, share: float, most: int, p: Params) -> np.ndarray:
    """At most ``most`` distinct unit vectors, by hash of the key."""
    picked = src if share >= 1 else src.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = picked.limit(int(most * 1.2)).toArrow()
    _, x = _valid(rows.column(1).combine_chunks(), p.dims) if rows.num_rows else (None, np.empty((0, p.dims), np.float32))
    return np.unique(_unit(x).astype(np.float32), axis=0)[:most] if len(x) else x


def similar(df: DataFrame, key: str = "chunk_key", vec: str = "vecs", p: Params = Params()) -> DataFrame:
    """``key``, ``neighbour``, ``similarity`` (6 decimals) and ``rank`` of the up to ``k`` most similar rows at or above ``floor``.

    Ties go to the smaller neighbour. Null, short, all-zero and non-finite vectors, and null keys, take no part; repeated
    rows count once; an empty table gives no rows. Rows with equal vectors are each other's neighbours at 1.0.
    Approximate: a neighbour is missed if none of the ``probes`` parts of a vector is its home; what is found is exact.

    Equal vectors are merged before vectors are shuffled, so a group of copies costs as much as one vector per task.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).alias("k"), F.col(vec).cast("array<float>").alias("v")).where("k is not null")

    # A sample by hash of the key, of a bounded size whatever the table is. Unfit vectors may be among it.
    total = src.count()
    x = _sampled(src, min(1.0, 1.1 * p.sample / max(total, 1)), p.sample, p)
    router = fit_router(x, p, total)
    # The members of each part to be expected, from its share of the sample.
    expected = np.bincount((x @ router).argmax(1), minlength=router.shape[1]) * (total / max(len(x), 1))
    deep = {int(i): int(math.ceil(expected[i] / (4 * p.deep))) for i in np.flatnonzero(expected > p.deep)}
    weights = spark.sparkContext.broadcast((router, np.maximum(1, np.ceil(expected / p.split)).astype(int), deep))

    def route(batches, inner: bool):
        """``inner``: rows of deep parts alone, which go on to their leaves, in as many slices as are worked on at once."""
        held: dict[bytes, set] = {}
        vectors: dict[bytes, tuple[bytes, np.ndarray]] = {}

        def flush():
            if not vectors:
                return
            names = list(vectors)
            router, slices, deep = weights.value
            top = _probed(np.stack([vectors[n][1] for n in names]), router, p.probes)
            cols: list[list] = [[] for _ in _KINDS]
            for i, name in enumerate(names):
                keys, raw, mark = sorted(held[name])[: p.k + 1], vectors[name][0], int.from_bytes(name[:4], "little")
                for j, part in enumerate(map(int, top[i])):
                    if inner and part in deep:
                        for col, value in zip(cols, (part, 0, mark % deep[part], 2 if j == 0 else 0, keys, raw)):
                            col.append(value)
                    elif not inner and part not in deep:
                        _spread(cols, part, 0, int(slices[part]), mark, j == 0, keys, raw)
            held.clear()
            vectors.clear()
            yield _batch(cols)

        for batch in batches:
            index, values = _valid(batch.column(1), p.dims)
            keys = batch.column(0).to_pylist()
            unit = _unit(values).astype(np.float32) if len(values) else values
            for i, at in enumerate(index):
                name = unit[i].tobytes()
                if name not in vectors:
                    vectors[name] = (pack(values[i]), unit[i])
                    held[name] = set()
                own = held[name]
                own.add(keys[at])
                if len(own) > 4 * p.k:
                    held[name] = set(sorted(own)[: p.k + 1])
            if len(vectors) > 4000:
                yield from flush()
        yield from flush()

    routed = src.mapInArrow(lambda batches: route(batches, False), _ROUTED)
    if deep:
        carried = src.mapInArrow(lambda batches: route(batches, True), _ROUTED)
        routed = routed.unionByName(_to_leaves(carried, _leaf_routers(src, weights, expected, p), deep, p))

    def compare(rows):
        # Roles: 0 a query from elsewhere, 1 a member that is queried in another slice, 2 both.
        base: dict[bytes, set] = {}
        asked: dict[bytes, set] = {}
        for batch in rows.to_batches():
            for role, keys, raw in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                if role:
                    base.setdefault(raw, set()).update(keys)
                if role != 1:
                    asked.setdefault(raw, set()).update(keys)
        members, queries = ([(sorted(keys)[: p.k + 1], raw) for raw, keys in held.items()] for held in (base, asked))
        out = [[], [], []]
        for at in range(0, len(members), p.block):
            for row in _search(members[at : at + p.block], queries, p):
                for col, value in zip(out, row):
                    col.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["k", "other", "sim"])

    near = routed.groupBy("part", "leaf", "slice").applyInArrow(compare, "k bigint, other bigint, sim double")
    return _copies(src, near, key, p)


def _leaf_routers(src: DataFrame, weights, expected: np.ndarray, p: Params) -> DataFrame:
    """``part``, ``weights`` and ``members`` of each leaf, by part: a router for each deep part, from a bounded sample of
    what is routed to it. Each is fitted by a task of its own; none of it passes through the driver."""
    # An expectation from few sampled vectors may be too low by a multiple; the fit takes no more than its share.
    shares = {part: min(1.0, 1.1 * p.sample / expected[part]) for part in weights.value[2]}

    def sample(batches):
        router, _, deep = weights.value
        for batch in batches:
            index, values = _valid(batch.column(1), p.dims)
            cols: list[list] = [[], []]
            if len(index):
                unit = _unit(values).astype(np.float32)
                for i, part in enumerate((unit @ router).argmax(1).tolist()):
                    if part in deep and _mark(unit[i][1:]) % 1_000_003 < shares[part] * 1_000_003:
                        cols[0].append(part)
                        cols[1].append(pack(values[i]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["part", "vec"])

    def fit(rows):
        part = rows.column("part")[0].as_py()
        x = np.unique(_unit(np.stack([unpack(raw, p.dims) for raw in rows.column("vec").to_pylist()])).astype(np.float32), axis=0)
        if len(x) > p.sample:
            x = x[np.random.default_rng(p.seed).permutation(len(x))[: p.sample]]
        router = fit_router(x, p, int(expected[part]))
        members = np.bincount((x @ router).argmax(1), minlength=router.shape[1]) * (expected[part] / len(x))
        return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([router.astype(np.float32).tobytes()], pa.binary()), "members": pa.array([members.tolist()], pa.list_(pa.float64()))})

    found = src.mapInArrow(sample, "part int, vec binary").groupBy("part").applyInArrow(fit, "part int, weights binary, members array<double>")
    return cut_lineage(found)


def _to_leaves(carried: DataFrame, routers: DataFrame, deep: dict[int, int], p: Params) -> DataFrame:
    """Members and visitors of deep parts, each at its leaves. The slices of a part each get a copy of its router."""
    # One row for each slice: of deep parts there are no more than a router has parts.
    pieces = local(routers.sparkSession, [(part, s) for part, n in deep.items() for s in range(n)], "part int, slice int")
    spread = routers.join(F.broadcast(pieces), "part").select("part", "slice", "weights", "members")

    def leaves(rows, routers):
        cols: list[list] = [[] for _ in _KINDS]
        if rows.num_rows:
            part = rows.column("part")[0].as_py()
            router, members = np.zeros((p.dims, 1), np.float32), [4.0 * p.deep * deep[part]]
            if routers.num_rows:
                router = np.frombuffer(routers.column("weights")[0].as_py(), dtype=np.float32).reshape(p.dims, -1)
                members = routers.column("members")[0].as_py()
            slices = np.maximum(1, np.ceil(np.array(members) / p.split)).astype(int)
            for batch in rows.to_batches(max_chunksize=4096):
                roles, keys, raws = (batch.column(i).to_pylist() for i in (3, 4, 5))
                unit = _unit(np.stack([unpack(raw, p.dims) for raw in raws])).astype(np.float32)
                for i, top in enumerate(_probed(unit, router, p.probes)):
                    for j, leaf in enumerate(map(int, top)):
                        _spread(cols, part, leaf, int(slices[leaf]), _mark(unit[i]), j == 0 and roles[i] == 2, keys[i], raws[i])
        return pa.Table.from_batches([_batch(cols)])

    return carried.groupBy("part", "slice").cogroup(spread.groupBy("part", "slice")).applyInArrow(leaves, _ROUTED)


def _copies(src: DataFrame, near: DataFrame, key: str, p: Params) -> DataFrame:
    """Add the rows of keys beyond the k + 1 smallest of their class, then rank all candidates of a key."""

    def classes(batches):
        for batch in batches:
            index, values = _valid(batch.column(1), p.dims)
            keys = batch.column(0).take(pa.array(index))
            unit = _unit(values).astype(np.float32) if len(values) else values
            names = [int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for u in unit]
            more = [int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=16).digest()[8:], "little", signed=True) for u in unit]
            yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.int64()), pa.array(more, pa.int64())], names=["k", "h", "g"])

    # Kept in the shared folder, 24 bytes a row, so that the vectors are not read and hashed again.
    keyed = cut_lineage(src.mapInArrow(classes, "k bigint, h bigint, g bigint"))
    first = Window.partitionBy("h", "g").orderBy("k")
    # dense_rank <= n is cut down before the shuffle, so a class of any size sends k + 2 rows a task.
    small = keyed.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= p.k + 2).select("h", "g", "k").distinct()
    lists = small.groupBy("h", "g").agg(F.sort_array(F.collect_set("k")).alias("ks")).where(F.size("ks") > p.k + 1)
    sized = lists.join(keyed.groupBy("h", "g").agg(F.count("*").alias("n")), ["h", "g"])
    # Of classes of more than HOT rows there are no more than rows / HOT, so these lists are broadcast and the rows stay.
    late = None
    for own in (F.broadcast(sized.where(F.col("n") > HOT)), sized.where(F.col("n") <= HOT)):
        rows = keyed.join(own, ["h", "g"]).where(F.col("k") > F.element_at("ks", p.k + 1))
        rows = rows.select("k", F.explode(F.slice("ks", 1, p.k)).alias("other"), F.lit(1.0).alias("sim"))
        late = rows if late is None else late.unionByName(rows)
    best = Window.partitionBy("k").orderBy(F.col("sim").desc(), "other")
    ranked = near.unionByName(late).groupBy("k", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= p.k).select(F.col("k").alias(key), F.col("other").alias("neighbour"), F.col("sim").alias("similarity"), "rank")


def pairs(found: DataFrame, key: str = "chunk_key") -> DataFrame:
    """``key_a`` < ``key_b`` of all rows of ``similar``, each pair once."""
    a, b = F.least(F.col(key), F.col("neighbour")), F.greatest(F.col(key), F.col("neighbour"))
    return found.select(a.alias("key_a"), b.alias("key_b")).distinct()
