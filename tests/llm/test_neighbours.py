"""Neighbours of every vector against brute force, and hard cases."""

import numpy as np
import pytest

from loamstack.llm.neighbours import Params, balanced_parts, fit_router, neighbour_graph, pack, pairs, similar, unpack

SCHEMA = "chunk_key long, vecs array<float>, k int, part string, other long"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], 1, "clash", 2) for k, v in rows], SCHEMA)


def brute(rows, p):
    good = {}
    for key, v in rows:
        if key is not None and v is not None and len(v) == p.dims and np.isfinite(v).all() and np.any(v):
            good.setdefault(key, []).append(np.asarray(v, dtype=np.float32).astype(float))
    keys = sorted(good)
    out = set()
    for a in keys:
        found = []
        for b in keys:
            if a != b:
                sim = max(round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6) for x in good[a] for y in good[b])
                if sim >= p.floor:
                    found.append((-sim, b))
        out |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(sorted(found)[: p.k])}
    return out


def rows_of(df):
    return {(r["chunk_key"], r["neighbour"], r["similarity"], r["rank"]) for r in df.collect()}


def test_hard_vectors(spark):
    p = Params(dims=4, k=2, floor=0.5)
    rows = [
        (1, [1, 0, 0, 0]), (2, [2, 0, 0, 0]), (3, [1, 0, 0, 0]), (4, [1, 0, 0, 0]), (5, [1, 0, 0, 0]), (6, [1, 0, 0, 0]), (7, [1, 1, 0, 0]), (8, [0, 0, 1, 0]),
        (9, None), (10, []), (11, [1, 2]), (12, [0, 0, 0, 0]), (13, [float("nan"), 1, 1, 1]), (14, [float("inf"), 1, 1, 1]), (None, [1, 0, 0, 0]), (1, [1, 0, 0, 0]), (15, [1e-30, 0, 0, 0]),
    ]
    found = rows_of(similar(frame(spark, rows), p=p))
    assert found == brute(rows, p)
    # Keys of a group of copies beyond the smallest have these as neighbours.
    assert {(b, r) for a, b, _, r in found if a == 6} == {(1, 1), (2, 2)}
    assert {(r["key_a"], r["key_b"]) for r in pairs(similar(frame(spark, rows), p=p)).collect()} == {(min(a, b), max(a, b)) for a, b, _, _ in found}


def test_empty(spark):
    assert similar(frame(spark, []), p=Params(dims=4)).count() == 0
    assert similar(frame(spark, [(1, [0, 0, 0, 0])]), p=Params(dims=4)).count() == 0


@pytest.fixture(scope="module")
def themes():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    of = np.concatenate([rng.integers(0, 40, 400), np.zeros(200, dtype=int)])
    return centres[of] + 0.25 * rng.standard_normal((600, 16))


def test_recall_with_several_parts(spark, themes):
    p = Params(dims=16, part=60, block=64, split=40)
    rows = list(enumerate(themes.astype(np.float32)))
    want, found = brute(rows, p), rows_of(similar(frame(spark, rows), p=p))
    hit = {(a, b) for a, b, *_ in want} & {(a, b) for a, b, *_ in found}
    assert len(hit) >= 0.9 * len(want)
    assert all(s >= p.floor for _, _, s, _ in found)


def test_recall_where_every_part_has_a_router_of_its_own(spark, themes):
    # A small sample cannot tell all parts apart, as with many millions of vectors and the usual one.
    p = Params(dims=16, part=60, block=64, split=40, sample=256, seen=32, deep=50)
    rows = list(enumerate(themes.astype(np.float32))) + [(600 + i, themes[0].astype(np.float32)) for i in range(30)]
    want, found = brute(rows, p), rows_of(similar(frame(spark, rows), p=p))
    asked = [w for w in want if w[0] % 50 == 0]
    assert len({w[:2] for w in want} & {f[:2] for f in found}) >= 0.9 * len(want) and len(asked) > 50
    # A group of copies has its neighbours among itself, whatever part it is in.
    assert {f for f in found if f[0] >= 600} == {w for w in want if w[0] >= 600}


def test_parts_are_balanced_and_follow_the_graph(themes):
    x = (themes / np.linalg.norm(themes, axis=1, keepdims=True)).astype(np.float32)
    graph = neighbour_graph(x, 10)
    label = balanced_parts(graph, x, 8, np.random.default_rng(1))
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.1 * 600 / 8 + 1
    assert (label[graph] == label[:, None]).mean() > 0.6
    weights = fit_router(x, Params(dims=16, part=60), 600)
    assert weights.shape[0] == 16 and weights.shape[1] >= 8


def test_packing_is_lossless():
    for v in (np.array([0.5, 1.25], np.float32), np.array([0.1, 1e-30], np.float32)):
        assert np.array_equal(unpack(pack(v), 2).astype(np.float32), v)
