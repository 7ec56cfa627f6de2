"""Term weights against plain Python."""

import math
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loamstack.llm import terms
from loamstack.llm.terms import most_distinctive, term_weights

ROWS = [
    ("/a", 1, "Alpha alpha BETA beta9 the"), ("/a", 2, "alpha gamma"), ("/a", 3, None), ("/a", 4, ""), ("/a", 1, "Alpha alpha BETA beta9 the"), ("/b", 5, "alpha delta delta"),
    ("/b", 6, "delta-delta ümlaut"), ("/c", 7, None), (None, 8, "alpha"), ("/b", 5, "another text"), ("/d", None, "alpha zeta zeta"),
]


def by_hand():
    pieces = defaultdict(set)
    for path, key, text in ROWS:
        if path is not None and text is not None:
            pieces[path, key].add(text)
    tf, holds = defaultdict(Counter), defaultdict(Counter)
    for (path, _), texts in pieces.items():
        found = [w for t in texts for w in re.findall("[a-z0-9]{4,}", t.lower())]
        tf[path].update(found)
        holds[path].update(set(found))
    total = len({r[0] for r in ROWS if r[0] is not None})
    out = {}
    for path in tf:
        for term, n in tf[path].items():
            counts = [tf[p][term] for p in tf if tf[p][term]]
            h = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
            out[path, term] = (holds[path][term], n, len(counts), round(math.log1p(n) * (1 - h / math.log(total)), 9), round(holds[path][term] * math.log(total / len(counts)), 9))
    return out


def frame(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "path string, chunk_key long, text string, tf int, term string")


def test_weights(spark):
    found = {(r["path"], r["term"]): (r["pieces"], r["tf"], r["records"], r["log_entropy"], r["rarity"]) for r in term_weights(frame(spark)).collect()}
    assert found == by_hand()


def test_most_distinctive_with_ties(spark):
    found = {r["path"]: r["term"] for r in most_distinctive(frame(spark), least_pieces=2).collect()}
    want = {}
    for path in ("/a", "/b"):
        want[path] = min((-w[4], t) for (p, t), w in by_hand().items() if p == path and w[4] > 0)[1]
    assert found == want
    assert {r["path"] for r in most_distinctive(frame(spark), least_pieces=4).collect()} == {"/a"}


def test_empty_and_text_keys(spark):
    assert term_weights(frame(spark).limit(0)).count() == 0
    named = frame(spark).selectExpr("path", "cast(chunk_key as string) as chunk_key", "text")
    assert {(r["path"], r["term"]): r["rarity"] for r in term_weights(named).collect()} == {k: v[4] for k, v in by_hand().items()}
    one = term_weights(frame(spark).where("path = '/b'")).collect()
    assert all(r["rarity"] == 0 for r in one) and all(r["log_entropy"] > 0 for r in one)


def test_a_piece_of_many_words_takes_linear_time(spark):
    words = [f"word{i % 20_000}" for i in range(40_000)]
    df = spark.createDataFrame([("a", 1, " ".join(words)), ("b", 2, "word1 other")], "path string, chunk_key long, text string")
    began = time.perf_counter()
    rows = {r["term"]: r for r in terms.term_weights(df).where("path = 'a'").collect()}
    assert time.perf_counter() - began < 5 and len(rows) == 20_000
    assert (rows["word1"]["tf"], rows["word1"]["pieces"], rows["word1"]["records"]) == (2, 1, 2)


def test_a_term_of_all_records_is_spread(spark):
    df = spark.range(3_000).selectExpr("concat('r', id) path", "id chunk_key", "concat('everywhere only', id) text")
    found = terms.term_weights(df).where("term = 'everywhere'")
    assert {(r["records"], r["rarity"]) for r in found.collect()} == {(3_000, 0.0)}
    assert found.groupBy(F.pmod(F.xxhash64("path"), F.lit(terms.SALTS))).count().count() == terms.SALTS
