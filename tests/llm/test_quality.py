"""Text quality: statistics, the robust estimate, and verdicts."""

import numpy as np

from loamstack.llm.quality import LIMIT, STATS, assess, describe, fit_prose

EN = "the of and a to in is was it that for on with as at by be this are from".split()
WORDS = [("en", w) for w in EN] + [("de", w) for w in "der die das und ist war nicht ein zu von mit auf dass".split()] + [(None, "x"), ("en", None), ("en", "the")]
PROSE = [f"In the {a} it was said that a {b} is from the {a}, and that this was for the best. It is on the list of the {b}." for a in ("house", "garden", "office") for b in ("letter", "note", "story", "plan")]
GERMAN = ["Das Haus ist nicht von der Stadt, und das war auf dem Plan. Die Leute sind mit dem Zug zu der Arbeit gefahren."] * 3
JUNK = ["\n".join(f"item_{i}: {i * 37}" for i in range(30)), "def f(x):\n    return x + 1\n\nfor i in range(3):\n    print(i)\n" * 3, "| a | b |\n" * 20, "Home | Up | Next\nPrint\nShare\nHelp\n" * 5, "QmFzZTY0" * 200]


def frames(spark):
    rows = [(i, t, "en-GB") for i, t in enumerate(PROSE * 4)] + [(100 + i, t, None) for i, t in enumerate(GERMAN)] + [(200 + i, t, "en") for i, t in enumerate(JUNK)]
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n", None), (0, PROSE[0], "en-GB"), (400, PROSE[0].replace(" ", "\n", 3), "EN")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as prose", "2 as distance", "3 as n_words")
    return df, spark.createDataFrame(WORDS, "lang string, word string")


def test_verdicts(spark):
    rows = {r["doc_id"]: r for r in assess(*frames(spark)).collect()}
    assert {k for k, r in rows.items() if r["prose"] is False} == {200, 201, 202, 203, 204}
    assert {k for k, r in rows.items() if r["prose"] is None} == {300, 301, 302}
    assert rows[100]["lang"] == "de" and rows[0]["lang"] == "en"
    assert all(abs(r["distance"] - sum(r[f"d_{s}"] for s in STATS)) < 1e-6 for r in rows.values() if r["distance"] is not None)


def test_statistics(spark):
    df, words = frames(spark)
    row = describe(df.where("doc_id = 200"), words).first()
    text = JUNK[0]
    visible = [c for c in text if not c.isspace()]
    assert row["n_words"] == 30 and abs(row["mean_word_len"] - 4) < 1e-9
    assert abs(row["digit_ratio"] - sum(c.isdigit() for c in visible) / len(visible)) < 1e-9
    assert abs(row["symbol_ratio"] - sum(not c.isalnum() for c in visible) / len(visible)) < 1e-9
    assert row["common_share"] == 0 and row["punct_lines"] == 0


def test_estimate_ignores_junk(spark):
    df, words = frames(spark)
    stats = describe(df, words).cache()
    clean = describe(df.where("doc_id < 200 or doc_id = 400"), words).cache()
    for code in ("", "en"):
        a, b = fit_prose(stats)[code], fit_prose(clean)[code]
        assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_no_prose_at_all_and_empty(spark):
    df, words = frames(spark)
    assert {r["prose"] for r in assess(df.where("doc_id between 200 and 204"), words).collect()} == {False}
    assert assess(df.limit(0), words).count() == 0
    assert assess(df, words.limit(0)).count() == df.count()


def test_the_distance_decides_where_running_text_alone_would_err(spark):
    df, words = frames(spark)
    # Function words without end read on like running text, but no prose is made of them alone.
    salad = spark.createDataFrame([(500, "the of and to in is was it that for " * 60 + ".", "en")], "doc_id long, text string, lang string")
    row = assess(df.select("doc_id", "text", "lang").unionByName(salad), words).where("doc_id = 500").first()
    assert row["running_share"] == 1.0 and row["distance"] > LIMIT and row["prose"] is False
    parts = {s: row[f"d_{s}"] for s in STATS}
    assert parts["running_share"] < 10 < max(parts["common_share"], parts["distinct_share"])
