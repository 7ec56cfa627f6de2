"""Chunking: unit vectors, and properties on arbitrary texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from loamstack.functions.chunking import chunk_rows, chunk_section_rows, chunk_sections, chunk_text, paragraphs, sentence_windows, tail

TEXTS = st.text(alphabet=st.sampled_from(list("ab é. \n\r　😀")), max_size=6000)


def test_long_paragraph_and_short():
    found = chunk_text("word " * 300 + "\n\nshort paragraph here")
    assert len(found) >= 2 and all(len(c) <= 1050 for c in found)


def test_short_texts():
    assert chunk_text("hello world this is a short document") == ["hello world this is a short document"]
    assert chunk_text("") == chunk_text("ab") == chunk_text(None) == chunk_text(" \n\n ") == []


def test_overlap_begins_at_a_word():
    first, second = ("alpha " * 120).strip(), ("beta " * 120).strip()
    found = chunk_text(f"{first}\n\n{second}")
    assert found[0] == first
    assert found[1].startswith("alpha alpha") and found[1].endswith(second)
    assert found[1] == tail(first, 120) + " " + second


def test_oversized_paragraph_has_no_overlap():
    before, big, after = "before " * 20, "x" * 1500, "after " * 20
    found = chunk_text(f"{before}\n\n{big}\n\n{after}")
    assert found == [before.strip(), "x" * 1000, "x" * 500, after.strip()]


def test_windows_end_behind_a_stop():
    text = "a" * 500 + ". " + "b" * 900
    assert list(sentence_windows(text)) == ["a" * 500 + ".", "b" * 900]


def test_windows_count_characters_not_bytes():
    text = "é" * 600 + ". " + "ü" * 600
    assert list(sentence_windows(text)) == ["é" * 600 + ".", "ü" * 600]


def test_windows_line_ends_and_paragraphs():
    assert paragraphs("a\r\n\r\nb\n\n\n\nc") == ["a", "b", "c"]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_properties(text):
    found = chunk_text(text)
    assert all(8 <= len(c) <= 1121 and c == c.strip() for c in found)
    assert all(len(w) <= 1000 for w in sentence_windows(text))


def test_rows(spark):
    rows = [(1, "hello world, one"), (2, None), (3, ""), (4, "y" * 2500), (4, "y" * 2500), (None, "null key stays")]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "'clash' as ordinal")
    found = sorted((r["id"] or 0, r["ordinal"], len(r["text"])) for r in chunk_rows(df, ["id"]).collect())
    assert found == [(0, 0, 14), (1, 0, 16), (4, 0, 1000), (4, 0, 1000), (4, 1, 1000), (4, 1, 1000), (4, 2, 500), (4, 2, 500)]
    assert chunk_rows(df.limit(0), ["id"]).count() == 0


def test_sections_keep_pages(spark):
    sections = [("first page text", 1), ("", 2), (None, 3), ("third page text", 4)]
    assert chunk_sections(sections) == [("first page text", 1), ("third page text", 4)]
    df = spark.createDataFrame([("p", sections)], "path string, sections array<struct<text:string,page:int>>")
    assert [(r.ordinal, r.page) for r in chunk_section_rows(df, ["path"]).orderBy("ordinal").collect()] == [(0, 1), (1, 4)]
