"""Retrieval against plain Python, ties and edge cases."""

import math
import re
from collections import Counter

from loamstack.operators import bm25, dense, fusion, search, stats

ROWS = [(1, "a/x.md", 0, "red apple red"), (2, "a/y.md", 0, "green apple"), (3, "b/z.md", 0, ""), (4, "b/z.md", 1, None), (5, "c/apple.md", 0, "blue stone"), (6, "d/y.md", 0, "green apple")]


def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_key long, path string, ordinal int, text string").selectExpr("*", "cast(null as int) page", "1.5 as score", "7 as rank")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def by_hand(query, field=3):
    terms = {r[0]: re.findall(r"\w+", (r[field] or "").lower()) for r in ROWS}
    n, avg = len(terms), sum(map(len, terms.values())) / len(terms)
    out = Counter()
    for t in re.findall(r"\w+", query.lower()):
        df = sum(t in v for v in terms.values())
        for k, v in terms.items():
            if t in v:
                tf = v.count(t)
                out[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / avg))
    return {k: round(s, 9) for k, s in out.items()}


def test_bm25(spark):
    found = bm25.search(chunks(spark), asked(spark, "red apple", "the", "", "apple apple", "zzz"), 10).collect()
    assert {r["chunk_key"]: r["score"] for r in found if r["query_id"] == 0} == by_hand("red apple")
    assert {r["query_id"] for r in found} == {0, 3}
    assert {r["chunk_key"]: r["score"] for r in found if r["query_id"] == 3} == by_hand("apple apple")
    assert [r["chunk_key"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 6]


def test_bm25_fields_and_empty(spark):
    found = bm25.search(chunks(spark), asked(spark, "apple"), 10, fields={"text": "text", "path": "path"}).collect()
    assert {r["chunk_key"] for r in found} == {1, 2, 5, 6}
    assert bm25.search(chunks(spark).limit(0), asked(spark, "apple"), 10).count() == 0


def vecs(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (4, [float("nan"), 1.0]), (6, [1.0]), (7, []), (8, [-1.0, 0.0]), (None, [1.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_key long, embedding array<float>")


def test_dense(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    assert [(r["chunk_key"], r["score"], r["rank"]) for r in dense.scan(vecs(spark), q, 3).orderBy("rank").collect()] == [(3, 1.0, 1), (5, 1.0, 2), (1, 0.0, 3)]
    assert [r["chunk_key"] for r in dense.scan(vecs(spark), q, 9, floor=0.5).collect()] == [3, 5]
    assert dense.scan(vecs(spark).limit(0), q, 3).count() == 0
    assert dense.scan(vecs(spark), q.limit(0), 3).count() == 0


def ranking(spark, *rows):
    return spark.createDataFrame([(1, p, o, r) for p, o, r in rows], "query_id int, path string, ordinal int, rank int")


def test_rrf_is_symmetric_and_breaks_ties(spark):
    a, b = ranking(spark, ("x", 0, 1), ("y", 0, 2)), ranking(spark, ("z", 0, 1), ("y", 0, 2))
    one, two = ([tuple(r) for r in fusion.rrf(list(pair), 5).orderBy("rank").collect()] for pair in ((a, b), (b, a)))
    assert one == two
    assert [(r[1], r[3]) for r in one] == [("y", round(2 / 61, 12)), ("x", round(1 / 60, 12)), ("z", round(1 / 60, 12))]


def test_hydrate_drops_but_does_not_renumber(spark):
    fused = fusion.rrf([ranking(spark, ("a/x.md", 0, 1), ("gone", 0, 2), ("a/y.md", 0, 3))], 5)
    hits = fusion.hydrate(fused, chunks(spark).select("path", "ordinal", "text", "page")).orderBy("rank").collect()
    assert [(h["path"], h["rank"], h["score"]) for h in hits] == [("a/x.md", 1, 1.0), ("a/y.md", 3, 0.33)]
    shown = fusion.render(fusion.hydrate(fused, chunks(spark).select("path", "ordinal", "text", "page"))).orderBy("rank").first()["rendered"]
    assert shown == "[1] a/x.md#chunk0 (score 1.00)\n    red apple red"


def test_hybrid(spark):
    q = spark.createDataFrame([(1, "apple", [0.0, 1.0]), (2, "", None), (3, "stone", None)], "query_id int, query string, embedding array<double>")
    hits = search.hybrid(chunks(spark), vecs(spark), q, 2).collect()
    # The fusion of both sides by hand; query 2 has nothing to go by, query 3 has words alone.
    by = {r[0]: r[1:3] for r in ROWS}
    near = dense.scan(vecs(spark), q.where("query_id = 1"), 8).collect()
    words = bm25.search(chunks(spark), q.where("query_id = 1"), 8, fields={"text": "text", "path": "path"}).collect()
    order = sorted((r for r in words), key=lambda r: (-r["score"], by[r["chunk_key"]]))
    parts = Counter()
    for ranked in (sorted((r for r in near if r["chunk_key"] in by), key=lambda r: r["rank"]),):
        for r in ranked:
            parts[by[r["chunk_key"]]] += 1 / (59 + r["rank"])
    for i, r in enumerate(order):
        parts[by[r["chunk_key"]]] += 1 / (60 + i)
    want = sorted(parts, key=lambda k: (-round(parts[k], 12), k))[:2]
    assert [(h["path"], h["chunk_index"]) for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == 1] == want
    assert {h["query_id"] for h in hits} == {1, 3}
    assert [h["path"] for h in hits if h["query_id"] == 3] == ["c/apple.md"]


def test_clamp_and_lookup(spark):
    assert [search.clamp_k(k) for k in (None, 0, 7, 99)] == [5, 1, 7, 25]
    assert search.by_ordinal(chunks(spark), "b/z.md", 1).count() == 1
    assert search.by_key(chunks(spark), 99).count() == 0


def test_percentiles(spark):
    values = [5.0, 1.0, 2.0, 2.0, 9.0, 4.0]
    row = stats.latency(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "g", "v").first()
    ranked = sorted(values)
    assert (row["n"], row["p50"], row["p95"]) == (6, ranked[3], ranked[5])
