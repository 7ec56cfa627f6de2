"""Scan noise: repairs of words the corpus knows, and what is left alone."""

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from loamstack.llm import scans
from loamstack.llm.scans import contexts, corrections, count_words, deletions, distance, headers, repair

PROSE = "The kernel summary was written before the deadline. The machine learned to return the document in the morning, and the on-call rota should remember it."
SCHEMA = "chunk_key long, path string, page int, text string, seen string, n int, _lines int"


def frame(spark, rows):
    base = [(10_000 + i, f"/p{i}", None, PROSE) for i in range(60)]
    return spark.createDataFrame([(k, p, g, t, "clash", 1, 2) for k, p, g, t in [*base, *rows]], SCHEMA)


ROWS = [
    (1, "/a", 1, "Small Kiln Guide\nThe machine leamed to retum the docurnent in the morning."), (2, "/a", 2, "Small Kiln Guide\nThe rnachine should rem-\nember the dead-\nline now.\n- 2 -"),
    (3, "/b", None, "The sum¬\nmary was wri\xadtten bef0re the dead!ine."), (4, "/b", None, "Page 3 of 9\nThe kernel summary."), (5, "/c", None, "a rota on-\ncall for the morning"),
    (6, "/c", None, "Codes like DOC-208, v2 and E0382 in room 3s stay."), (7, "/c", None, None), (8, "/c", None, ""), (9, "/c", None, "Readings:\n727\n288\n690"), (10, None, None, PROSE), (4, "/b", None, "Page 3 of 9\nThe kernel summary."),
    (11, "/c", None, "The ﬁrst deadline and the ﬂoor. The machine oﬀered the document."), (12, "/d", 1, "Storage\nThe machine learned to return."), (13, "/c", None, "x" * 100_000), (14, "/c", None, " \n \n \nThe machine learned."),
]


@pytest.fixture(scope="module", params=[300_000, 0], ids=["broadcast", "joined"])
def found(spark, request):
    return {r["chunk_key"]: r for r in repair(frame(spark, ROWS), broadcast_rows=request.param).where("chunk_key < 10000").collect()}


def test_repairs(found):
    assert found[1]["repaired"] == "The machine learned to return the document in the morning."
    assert set(found[1]["kinds"]) == {"header", "misread"}
    assert found[2]["repaired"] == "The machine should remember the deadline now."
    assert set(found[2]["kinds"]) == {"break", "header", "misread", "page"}
    assert found[3]["repaired"] == "The summary was written before the deadline."
    assert found[4]["repaired"] == "The kernel summary." and found[4]["kinds"] == ["page"]


def test_leaves_alone(found):
    for key in (5, 6, 7, 8, 9, 10, 12, 13, 14):
        text = next(t for k, _, _, t in ROWS if k == key)
        assert (found[key]["repaired"], found[key]["kinds"]) == (text, []), key
    assert len(found) == 14


def test_empty(spark):
    assert repair(frame(spark, []).limit(0)).count() == 0


def test_distance_and_index():
    assert distance("rnodern", "modem") <= 1 and distance("tlie", "the") <= 1 and distance("bef0re", "before") <= 0.5
    assert distance("table", "cable") > 1 and distance("ab", "abc") > 1
    assert deletions("rnachine", ["rn"]) & deletions("machine", ["m"])


def test_words_misread_with_several_digits(spark):
    base = [(100 + i, f"/q{i}", None, "The postmortem and the download or upload were ready.") for i in range(20)]
    rows = [(1, "/a", None, "LARGE P0STM0RTEM FOR ALL"), (2, "/b", None, "the d0wnl0ad"), (3, "/c", None, "an upload/d0wnl0ad, ready"), (4, "/d", None, "E0382, i18n, c0a1e5d8 and /srv/d0wnl0ad.txt or Zm9v/bWFj0aGlu= stay")]
    found = {r["chunk_key"]: (r["repaired"], r["kinds"]) for r in repair(frame(spark, [*base, *rows])).where("chunk_key < 100").collect()}
    assert found == {1: ("LARGE POSTMORTEM FOR ALL", ["misread"]), 2: ("the download", ["misread"]), 3: ("an upload/download, ready", ["misread"]), 4: (rows[3][3], [])}


@pytest.mark.parametrize("width", [32, 44, 72, 120])
def test_page_numbers_of_wide_pages(spark, width):
    rows = [(1, "/a", None, f"{'17':>{width}}\nThe machine learned to return."), (2, "/b", None, f"The machine learned to return.\n{'9':^{2 * width}}")]
    found = {r["chunk_key"]: (r["repaired"], r["kinds"]) for r in repair(frame(spark, rows)).where("chunk_key < 100").collect()}
    assert found == {1: ("The machine learned to return.", ["page"]), 2: ("The machine learned to return.", ["page"])}


@pytest.mark.parametrize("rows", [300_000, 0], ids=["broadcast", "joined"])
def test_each_occurrence_is_repaired_by_its_own_context(spark, rows):
    # "hcar" is a misread "bear" or "hear": which one, the words around it tell.
    base = [(200 + i, f"/e{i}", None, "they saw a brown bear there and could hear the music clearly") for i in range(60)]
    text = "they saw a brown hcar there and could hcar the music clearly"
    table = frame(spark, [*base, (1, "/a", None, text)])
    words = count_words(table).select("word", "n")
    assert {r["meant"] for r in corrections(words).where("seen = 'hcar'").collect()} >= {"hear"}
    found = {r["chunk_key"]: r["repaired"] for r in repair(table, broadcast_rows=rows).where("chunk_key = 1").collect()}
    options = {r["meant"] for r in corrections(words).where("seen = 'hcar'").collect()}
    want = "they saw a brown bear there" if "bear" in options else "they saw a brown hear there"
    assert found[1] == want + " and could hear the music clearly"


def test_context_of_several_places(spark):
    base = [(200 + i, f"/e{i}", None, "the modem hums loudly while modern art hangs quietly") for i in range(60)]
    table = frame(spark, [*base, (1, "/a", None, "the mo0ern hums loudly while mo0ern art hangs quietly")])
    found = repair(table).where("chunk_key = 1").first()
    assert "modern art" in found["repaired"] or found["kinds"] == []


def test_long_words_are_repaired_too(spark):
    word = "straßenbahnhaltestellenüberdachungsprüfungsämter"
    base = [(200 + i, f"/e{i}", None, f"Die {word} kommen dort.") for i in range(20)]
    bad = word.replace("dach", "clach", 1)
    found = repair(frame(spark, [*base, (1, "/a", None, f"Die {bad} kommen dort.")])).where("chunk_key = 1").first()
    assert found["repaired"] == f"Die {word} kommen dort."
    assert distance("rn" + "a" * 200_000, "m" + "a" * 200_000) <= 0.5


def test_the_header_of_a_chapter_counts_in_a_long_file(spark):
    rows = [(i, "/long", i, ("Chapter On Kilns\n" if i < 9 else "") + f"The machine number{i} learned to return the document.") for i in range(1, 400)]
    assert [tuple(r) for r in headers(frame(spark, rows), "path", "chunk_key", "text", "page").collect()] == [("/long", "chapter on kilns")]


def test_seeking_words_first_changes_nothing(spark, monkeypatch):
    base = [(200 + i, f"/e{i}", None, "the modem hums loudly while modern art hangs quietly; they lease or least") for i in range(40)]
    table = frame(spark, [*base, (1, "/a", None, "a modem 1ease,leasf hums"), (2, "/a", None, "the mo0ern art")])
    fixes = corrections(count_words(table).select("word", "n"))
    one = sorted(map(tuple, contexts(table, fixes).collect()))
    monkeypatch.setattr(scans, "HINTED", -1)
    assert sorted(map(tuple, contexts(table, fixes).collect())) == one


def test_a_repair_that_is_misread_itself_leads_on(spark):
    base = [(200 + i, f"/e{i}", None, "nobody comes without a folder") for i in range(120)] + [(400 + i, f"/f{i}", None, "nobody comes witliout a folder") for i in range(6)]
    table = frame(spark, [*base, (1, "/a", None, "nobody comes wit1iout a folder")])
    assert [tuple(r)[:2] for r in corrections(count_words(table).select("word", "n")).where("seen = 'wit1iout'").collect()] == [("wit1iout", "without")]


ODD = [None, "", " \n", PROSE, "ΟΔΟΣ ΣΑΣ\x85Σ İstanbul", "a\x1fdead!ine　docurnent,\xa0docurnent", "The the THE\tthe/modem x=1 Zm9vMTIzNDU2Nzg5MDEyMzQ1Njc4OTA=", "x" * 5000, PROSE, "one\x00two \r\n three"]


def test_words_are_those_of_distinct_pieces(monkeypatch):
    texts = pa.array([*ODD, *[PROSE] * 500])
    found = [scans.words_of(t or "") for t in texts.to_pylist()]
    looked = []
    monkeypatch.setattr(scans, "words_of", lambda t, was=scans.words_of: looked.append(t) or was(t))
    pieces = scans.Pieces(texts)
    assert len(looked) == len(set(looked)) < 100
    assert pieces.counts() == Counter(w for words in found for w in words)
    follow = Counter(p for words in found for p in zip(words, words[1:]))
    assert pieces.pairs(None) == follow
    for wanted in ({"the", "docurnent"}, {"σας"}, {"none"}, set()):
        assert pieces.pairs(wanted) == {p: n for p, n in follow.items() if not wanted.isdisjoint(p)}
        assert pieces.having(wanted).tolist() == [i for i, words in enumerate(found) if not wanted.isdisjoint(words)]


def test_batches_are_cut_without_loss(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array(ODD)], names=["k", "t"])
    for size in (1, 300, 10**9):
        monkeypatch.setattr(scans, "SLICE_BYTES", size)
        parts = list(scans._slices(batch, 1))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert sum((Counter(scans.Pieces(p.column(1)).counts()) for p in parts), Counter()) == Counter(w for t in ODD for w in scans.words_of(t or ""))
    assert list(scans._slices(batch.slice(0, 0), 1)) == []


def test_texts_passed_over_have_no_trace():
    white = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != "\n"]
    digits = [chr(c) for c in range(0x110000) if chr(c).isdecimal()]
    lines = ["Page 3 of 9", "S.12", "pp. 7", "- 2 -", "–3–", "12 |", "[9]", "3/4", "xiv", "lxxxix", f"{'17':>80}", "12", "Kiln Manual   13", "12   Kiln Manual", "The mod-", "The mod- ", "modem‐", "sum\xadmary", "ﬁrst", "sum¬"]
    lines += [w + x + w for w in white for x in ("12", "Page 3", "iv", "[9]", "2   Kiln Manual")] + [f"Page{w}3" for w in white]
    lines += [x for d in digits for x in (d, f"p. {d}", f"-{d}-", f"{d} |", f"[{d}]", f"{d}/{d}", f"Kiln Manual   {d}", f"{d}    Kiln Manual")]
    texts = [t for x in lines for t in (x, f"{x}\nern machine learned", f"The machine learned\n{x}", f"The machine\n{x}\nern learned")]
    repairer = scans.Repairer({}, {}, {"first"})
    kinds = [repairer.text(t, frozenset())[1] for t in texts]
    traced = pc.match_substring_regex(pa.array(texts), scans._TRACE).to_pylist()
    assert [t for t, k, found in zip(texts, kinds, traced) if k and not found] == []
    assert set().union(*kinds) == {"page", "header", "break", "fused"}
    assert not any(pc.match_substring_regex(pa.array([PROSE, "", "Notes:\nwell-known, 7 of 12 are (3) here"]), scans._TRACE).to_pylist())


@pytest.mark.parametrize("rows", [300_000, 0], ids=["broadcast", "joined"])
def test_traces_are_the_kinds_of_the_repair(spark, rows):
    table = frame(spark, ROWS)
    want = sorted((r["chunk_key"], r["kinds"]) for r in repair(table, broadcast_rows=rows).collect() if r["kinds"])
    assert len(want) > 5
    assert sorted(map(tuple, scans.traces(table, broadcast_rows=rows).collect())) == want


def test_texts_are_read_three_times(spark):
    # For words and headers, for contexts, and for the repair; once more without the texts, for the sizes of files.
    base = [(200 + i, f"/e{i}", None, "the modem hums loudly while modern art hangs quietly; they lease or least") for i in range(40)]
    table = frame(spark, [*base, (1, "/a", None, "they leasf or hum")])
    assert contexts(table, corrections(count_words(table).select("word", "n"))).count() > 0
    n, read = table.count(), spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    repair(table.mapInArrow(told, table.schema)).collect()
    assert read.value == 4 * n
