"""Scalar functions."""

import pytest
from pyspark.sql import functions as F

from loamstack.functions import text, vectors
from loamstack.operators.embed import HashedWords, hashed_parts, masked_mean


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  The data-\nbase   migra-\ntion plan\n\n\nﬁnal  step\nNext-\nYear", "The database migration plan\n\nfinal step\nNext-\nYear"),
        (" \n \n", ""),
        (None, None),
    ],
)
def test_clean(spark, raw, want):
    assert value(spark, text.clean(F.lit(raw).cast("string"))) == want


def test_tidy(spark):
    assert value(spark, text.tidy(F.lit("  Invoice   4821 \n\n  due  soon\n"))) == "Invoice 4821\ndue soon"


@pytest.mark.parametrize(("raw", "want"), [("", False), ("| . ~ i", False), ("Hello", False), ("Invoice 4821", True)])
def test_has_text(spark, raw, want):
    assert value(spark, text.has_text(F.lit(raw))) is want


@pytest.mark.parametrize(("path", "ext", "stat"), [("/a/B.MD", "md", "md"), ("/a/.env", "", "noext"), ("/a/prod.env", "env", "env"), ("/a/Makefile", "makefile", "noext"), ("/a.b/c", "", "noext")])
def test_extensions(spark, path, ext, stat):
    assert (value(spark, text.ext_of(F.lit(path))), value(spark, text.stats_ext(F.lit(path)))) == (ext, stat)


def test_query_terms(spark):
    assert value(spark, text.query_terms(F.lit("Notes on THE json-rpc E0382, " + "x" * 40))) == ["notes", "json", "rpc", "e0382"]
    assert value(spark, text.query_terms(F.lit("what is the"))) == []


@pytest.mark.parametrize(("path", "want"), [("/docs/a", True), ("/docs", True), ("/docs-other/a", False), ("docs/a", False), ("/docs/../etc", False)])
def test_under_root(spark, path, want):
    assert value(spark, text.under_root(F.lit(path), "/docs")) is want


def test_display_score(spark):
    assert [value(spark, text.display_score(F.lit(r), F.lit(3))) for r in (1, 2, 3)] == [1.0, 0.67, 0.33]


def test_vectors(spark):
    a = F.lit([3.0, 4.0])
    assert value(spark, vectors.dot(a, F.lit([1.0, 1.0, 9.0]))) == 7.0
    assert value(spark, vectors.l2_normalize(a)) == [0.6, 0.8]
    assert all(x != x for x in value(spark, vectors.l2_normalize(F.lit([0.0, 0.0]))))
    hidden = F.array(F.lit([1.0, 2.0]), F.lit([3.0, 4.0]), F.lit([9.0, 9.0]))
    assert value(spark, vectors.masked_mean(hidden, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 3.0]
    import numpy as np

    assert masked_mean(np.array([[[1.0, 2.0], [3.0, 4.0]]]), np.array([[1, 0]])).tolist() == [[1.0, 2.0]]


def test_hashed_embedding_in_both_forms(spark):
    words = "alpha beta beta gamma"
    row = HashedWords(64).embed([words, ""])
    parts = hashed_parts(spark.createDataFrame([(1, words), (2, ""), (3, None)], "id int, text string"), "id", dims=64).collect()
    assert {r["bucket"]: r["weight"] for r in parts} == {i: round(x, 9) for i, x in enumerate(row[0]) if x}
    assert not row[1].any() and {r["id"] for r in parts} == {1}
