"""Wrong encodings: round trips on words the corpus knows."""

import pytest

from loamstack.llm.encoding import model_of, repair

GOOD = [
    "Le résultat a été noté dans la marge, après la réunion déjà prévue.", "Die Kollegen äußerten sich später über die Prüfliste für das Gewächshaus.",
    "Mañana se revisará el catálogo y la versión en el cajón, según la guía.", "Não sabemos onde ficou a cópia de segurança. ATENÇÃO, não apagar.",
    "It’s only “spring” — and the naïve résumé cost 30 €, ±2 µm.", "Список лежит на столе, а ключ лежит в ящике стола.",
]
ODD = ["SÃO JOÃO é o nome.", "«la fiche» – voir α et β", "Łódź, İzmir", "x ? y : z", "a?b=c", "plain"]


def run(spark, texts):
    rows = [(i, t) for i, t in enumerate([*GOOD * 40, *texts])]
    df = spark.createDataFrame(rows, "chunk_key long, text string").selectExpr("*", "1 as garbled", "2 as restored", "3 as pair")
    return {r["chunk_key"] - len(GOOD) * 40: r for r in repair(df).collect()}


@pytest.fixture(scope="module")
def cases():
    return [
        (GOOD[0].encode().decode("cp1252"), GOOD[0]), (GOOD[1].encode().decode("mac_roman"), GOOD[1]), (GOOD[2].encode("cp1252").decode("mac_roman"), GOOD[2]),
        (GOOD[2].encode().decode("latin-1"), GOOD[2]), (GOOD[1].encode("cp1252").decode("cp1251"), GOOD[1]), (GOOD[0].encode("cp850").decode("cp1252"), GOOD[0]),
        (GOOD[0].encode().decode("latin-1").encode().decode("latin-1"), GOOD[0]), (GOOD[5].encode().decode("latin-1"), GOOD[5]),
        ("plain words, then " + "été noté".encode().decode("latin-1") + " and on", "plain words, then été noté and on"),
    ]


def test_restores_and_leaves_alone(spark, cases):
    texts = [bad for bad, _ in cases] + ODD + [None, "", " \n ", "caf� near", "?????? ????? ?? ?????."]
    found = run(spark, texts)
    for i, (bad, good) in enumerate(cases):
        assert found[i]["garbled"], bad
        assert found[i]["restored"] == good
    at = len(cases)
    for i, text in enumerate(ODD):
        assert (found[at + i]["garbled"], found[at + i]["restored"]) == (False, text)
    at += len(ODD)
    assert [(found[at + i]["garbled"], found[at + i]["restored"]) for i in range(3)] == [(False, None), (False, ""), (False, " \n ")]
    assert found[at + 3]["garbled"] and found[at + 4]["garbled"]
    assert not any(r["garbled"] or r["restored"] != GOOD[(k + len(GOOD) * 40) % len(GOOD)] for k, r in found.items() if k < 0)


UNSPACED = "日本語の文章は単語の間に空白を置かないので、長い文でも一つの語のように見えます。倉庫の鍵は机の引き出しに入っています。会議の記録は来週までに棚へ戻してください。"


@pytest.mark.parametrize("size", [20, 70, 100, 116, 5_000])
@pytest.mark.parametrize("read", ["latin-1", "mac_roman"])
def test_length_of_an_unspaced_text_changes_nothing(spark, size, read):
    good = (UNSPACED * (size // len(UNSPACED) + 1))[:size]
    found = run(spark, [UNSPACED, good.encode().decode(read), UNSPACED[5:]])
    assert (found[1]["garbled"], found[1]["restored"]) == (True, good)
    assert not found[0]["garbled"] and not found[2]["garbled"]


def test_garbled_passage_of_a_long_word(spark):
    honest = "über\xa0den\xa0Zaun\u2003"
    bad, good = (honest * 30 + x + "\xa0" + honest * 30 for x in ("Prüfliste".encode().decode("latin-1"), "Prüfliste"))
    found = run(spark, [bad, honest * 60])
    assert (found[0]["garbled"], found[0]["restored"]) == (True, good)
    assert not found[1]["garbled"]


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([(1, "é" * 200_000 + "x" * 200_000)], "chunk_key long, text string")
    assert not repair(df).first()["garbled"]
    assert repair(df.limit(0)).count() == 0


def test_escapes_are_steps_of_the_search(spark, cases):
    texts = ["&Atilde;&copy;t&Atilde;&copy; ici", "\\u00c3\\u00a9t\\u00c3\\u00a9 ici", "&amp;Atilde;&amp;copy;t&amp;Atilde;&amp;copy; ici", "&eacute;t&eacute; ici", "a &amp; b", "R&D \\usr &c;"]
    found = run(spark, texts)
    assert [(found[i]["garbled"], found[i]["restored"]) for i in range(3)] == [(True, "été ici")] * 3
    assert [(found[i]["garbled"], found[i]["restored"]) for i in range(3, 6)] == [(False, t) for t in texts[3:]]


def test_joined_fixes_give_what_broadcast_ones_give(spark, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*GOOD * 40, *(bad for bad, _ in cases), None, ""])], "chunk_key long, text string")
    rows = [sorted(map(tuple, repair(df, broadcast_rows=n).collect())) for n in (300_000, 0)]
    assert rows[0] == rows[1] and sum(g for _, g, _ in rows[0]) == len(cases)


def test_model_counts_whole_words():
    pairs, words = model_of({"\xa0" * 1_000 + "été": 3})
    assert pairs["té"] == pairs["é$"] == 3 and pairs["\xa0\xa0"] == 2_997 and words["été"] == 3
