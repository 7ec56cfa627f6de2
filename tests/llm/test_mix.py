"""Mixing: quotas, caps, the splitting tree."""

import os

import numpy as np
import pytest

from loamstack.llm.mix import Params, cut_again, deal, make_plan, mix, shards, shares, split_tree
from loamstack.llm.tokenize import RANKS, TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, RANKS)), reason="no vocabulary here")


def docs(spark):
    rows = [(i, "word " * (5 + i % 7), " Big" if i % 3 else "BIG ") for i in range(600)] + [(1000 + i, "word " * 6, "small") for i in range(10)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "word", None), (2003, "word word", "untargeted"), (None, "word", "big"), (0, "word " * 5, "BIG ")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as uses", "2 as block", "3 as mark")


def targets(spark):
    return spark.createDataFrame([("big", 0.7, 2), ("Small ", 0.2, 3), ("nothing", 0.1, 4)], "source string, target_share double, max_repeats int")


def test_mix(spark):
    p = Params(blocks=16, shards=8)
    rows = mix(docs(spark), targets(spark), p=p).collect()
    assert len(rows) == 614
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["uses"] == 0 for k in (2000, 2001, 2002, 2003))
    total = sum(r["uses"] * r["n_tokens"] for r in rows)
    for source, want, most in (("big", 0.7 / 0.9, 2), ("small", 0.2 / 0.9, 3)):
        own = [r for r in rows if r["source"] == source]
        got = sum(r["uses"] * r["n_tokens"] for r in own) / total
        assert abs(got - want) < 0.05 and max(r["uses"] for r in own) <= most
        assert all(abs(r["actual_share"] - got) < 1e-9 for r in own)
    # The small source decides the total: it is used as often as allowed.
    assert {r["uses"] for r in rows if r["source"] == "small" and r["n_tokens"]} == {3}
    report = {r["source"]: r for r in shares(docs(spark), targets(spark), p=p).collect()}
    assert report["nothing"]["actual_share"] == 0 and report["small"]["most_uses"] == 3
    dealt = shards(docs(spark), targets(spark), p=p).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in dealt) == sorted((r["doc_id"], c) for r in rows for c in range(r["uses"]))
    assert {r["shard"] for r in dealt} <= set(range(8))


def test_repeated_runs_agree(spark):
    p = Params(blocks=16, shards=8)
    one, two = (sorted(map(tuple, mix(docs(spark).repartition(n), targets(spark), p=p).select("doc_id", "uses").collect())) for n in (1, 7))
    assert one == two


def test_empty(spark):
    assert mix(docs(spark).limit(0), targets(spark)).count() == 0
    assert {r["uses"] for r in mix(docs(spark), targets(spark).limit(0)).collect()} == {0}


def test_tree_deals_exactly():
    counts = np.array([100, 7, 0, 33])
    dealt = split_tree(counts, 16, np.random.default_rng(1))
    assert dealt.shape == (16, 4) and (dealt.sum(0) == counts).all()
    assert dealt.sum(1).max() - dealt.sum(1).min() <= 4


def test_plan_keeps_to_quota():
    sizes = {"a": {b: 100 + b for b in range(50)}, "b": {0: 10}}
    plan = make_plan(sizes, {"a": (0.5, 3), "b": (0.5, 2)}, Params(blocks=50, shards=4))
    assert plan.quota == {"a": 20.0, "b": 20.0}
    assert plan.cut == [("a", plan.cut[0][1], 20)] and {u for s, _, u in plan.uses if s == "b"} == {2}
    assert make_plan({}, {"a": (1.0, 1)}, Params()).uses == []


def test_cut_blocks_are_cut_again_and_dealt_by_the_tree():
    sizes = {"a": {b: 100 for b in range(50)}, "b": {0: 1_000}}
    p = Params(shards=4)
    plan = make_plan(sizes, {"a": (0.5, 1), "b": (0.5, 4)}, Params(shards=4, total=2_130))
    assert plan.quota == {"a": 1_065.0, "b": 1_065.0} and len(plan.cut) == 2
    cut_again(plan, {(s, b): {i: 10 for i in range(sizes[s][b] // 10)} for s, b, _ in plan.cut}, p)
    assert sum(s == "a" for s, *_ in plan.whole) == 6 and [x[3] for x in plan.last] == [5, 5]
    units = deal(plan, p)
    assert len(units) == len(set(units)) == 10 + 1 + 6 + 6 + 2
    shards_of = {}
    for s, b, part, copy, shard in units:
        assert shards_of.setdefault((s, b, part, copy), shard) == shard
    with pytest.raises(ValueError):
        deal(plan, Params(units=5))


def test_shares_are_exact_to_a_record(spark):
    big = spark.range(20_000).selectExpr("id doc_id", "repeat('word ', 3 + cast(id % 5 as int)) text", "'big' source")
    few = spark.range(200).selectExpr("id + 50000 doc_id", "'word word word word' text", "'few' source")
    want = spark.createDataFrame([("big", 0.9, 1), ("few", 0.1, 3)], "source string, target_share double, max_repeats int")
    rows = {r["source"]: r for r in shares(big.unionByName(few), want, p=Params(blocks=64, parts=8, total=20_000)).collect()}
    assert 0 <= 18_000 - rows["big"]["tokens"] < 8 and 0 <= 2_000 - rows["few"]["tokens"] < 8
