"""Cutting oversized texts: properties, and ranges against whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstack.llm import split
from loamstack.llm.split import LIMIT, OVERLAP, WHITE_SPACE, _pieces, split_files, split_oversized, split_tables

ALPHABET = st.sampled_from(list("abc dé.\n! \r\t　😀") + ["word ", "\n\n", ". ", "x" * 40])


def cut(text, limit=LIMIT, overlap=OVERLAP):
    return list(_pieces(text, 0, len(text), len(text), limit, overlap))


@settings(max_examples=80, deadline=None)
@given(st.lists(ALPHABET, max_size=1500).map("".join), st.sampled_from([(1000, 120), (100, 10), (50, 0)]))
def test_properties(text, sizes):
    limit, overlap = sizes
    found = cut(text, limit, overlap)
    if not text:
        assert found == []
        return
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in found)
    assert all(0 <= b - c <= overlap and c > a for (a, b), (c, _) in zip(found, found[1:]))


def test_prefers_paragraphs_then_lines_then_sentences_then_words():
    pad = "w" * 10 + " "
    body = pad * 54
    assert cut(body + "\n\n" + pad * 20 + "\n" + pad * 50)[0][1] == len(body) + 2
    assert cut(body + "x\n" + pad * 10 + "end. " + pad * 80)[0][1] == len(body) + 2
    assert cut(body + "end. " + pad * 80)[0][1] == len(body) + 5
    assert cut(pad * 200)[0][1] == 990
    assert cut("x" * 2500) == [(0, 1000), (880, 1880), (1760, 2500)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'clash' as body", "1 as ordinal", "2 as piece", "3 as length")


def test_rows_and_ranges_agree(spark):
    long = "".join(f"Sentence number {i} stands here. " + ("\n\n" if i % 9 == 0 else "") for i in range(400)) + "y" * 3000 + " é😀" * 900
    rows = [(1, long), (2, None), (3, ""), (4, " \n" * 900), (5, "z" * 1000), (6, "  " + "z" * 1000 + "　\n"), (7, "z" * 1001), (1, long), (None, "q " * 700)]
    df = frame(spark, rows)
    whole = sorted(map(tuple, split_oversized(df, ["id"]).collect()), key=str)
    assert {r[0] for r in whole} == {1, 7, None}
    parts = sorted(map(tuple, split_oversized(df, ["id"], range_chars=1500).collect()), key=str)
    assert parts == whole
    one = [r for r in whole if r[0] == 1]
    assert sorted(r[1] for r in one) == list(range(len(one)))
    text = long.strip(WHITE_SPACE)
    assert all(text[r[2] : r[2] + r[3]] == r[4] for r in one)
    assert split_oversized(df.limit(0), ["id"]).count() == 0


def test_tables(spark):
    sections = spark.createDataFrame([(1, "/a", 0, "s " * 800, 2), (1, "/a", 0, "s " * 800, 2)], "section_id long, path string, section_no int, text string, page int")
    chunks = spark.createDataFrame([(1, "/b", 0, "c " * 800, None), (2, None, None, None, None)], "chunk_key long, path string, ordinal int, text string, page int")
    found = split_tables(sections, chunks).collect()
    assert {(r["item_kind"], r["item_id"], r["page"]) for r in found} == {("section", 1, 2), ("chunk", 1, None)}
    assert len(found) == 4


def giant():
    rng = random.Random(3)
    words = ["wort", "größer", "été", "猫", "a", "naïve", "x" * 1_400, "end.", "stop!\n", "\n\n", "\u2003", "𝒳y"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ""]) for _ in range(4_000))


@pytest.mark.parametrize("size", [700, 4_096])
def test_files_by_byte_ranges_give_what_the_direct_way_gives(spark, tmp_path, size):
    texts = {"a.txt": "  \n " * 900 + giant() + " \n" * 700, "b.txt": "short", "c.txt": "word " * 300, "d.txt": "", "e.txt": "\u3000" * 3_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = {}
    for r in split_files(spark, str(tmp_path), range_bytes=size).collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["ordinal"], r["start"], r["length"], r["piece"]))
    assert set(found) == {"a.txt", "c.txt"}
    for name, rows in found.items():
        body = texts[name].strip(WHITE_SPACE)
        want = [(i, a, b - a, body[a:b]) for i, (a, b) in enumerate(_pieces(body, 0, len(body), len(body), 1_000, 120))]
        assert sorted(rows) == want


def test_tables_are_stitched_in_a_tree(spark, monkeypatch):
    # Three levels of blocks of four ranges.
    monkeypatch.setattr(split, "FAN", 4)
    text = giant()[:60_000]
    made = [(7, i, *split._table(text, 0, at, min(at + 1_200, len(text)), len(text), 1_000, 120)) for i, at in enumerate(range(0, len(text), 1_200))]
    tables = spark.createDataFrame([(a, b, c, d.tolist(), e.tolist()) for a, b, c, d, e in made], split._TABLES)
    rows = {r["_range"]: (r["_entry"], r["_ordinal"]) for r in split._stitched(tables, 3).collect()}
    starts = [a for a, _ in _pieces(text, 0, len(text), len(text), 1_000, 120)]
    want = {}
    for i, a in enumerate(starts):
        want.setdefault(a // 1_200, (a, i))
    assert rows == want


def test_repeated_rows_with_null_keys_count_once(spark):
    rows = [(None, "x " * 900, None), (None, "x " * 900, None), (1, "y " * 900, "p"), (1, "y " * 900, "p"), (1, "z " * 900, "p")]
    df = spark.createDataFrame(rows, "id long, text string, path string")
    assert split_oversized(df, ["id", "path"]).where("ordinal = 0").count() == 3
