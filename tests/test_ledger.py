"""The work ledger: leases, fencing, repeated runs, and the catch-up query."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamstack.operators.ledger import Ledger, StaleWriter, catch_up, changed_files, hash_value
from loamstack.publish import Heads, Overtaken

SCANS = "path string, hash string, seen_at timestamp_ntz, scan_id long, size long, rank int"
DOCS = "path string, hash string, mtime_secs long, size long"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def scans(spark, *rows):
    return spark.createDataFrame([(p, h, at(t), i, None, 1) for p, h, t, i in rows], SCANS)


def docs(spark, *rows):
    return spark.createDataFrame([(p, h, 1, 1) for p, h in rows], DOCS)


def test_hash_notations(spark):
    df = spark.createDataFrame([("0x00AB",), ("ab",), ("AB",), ("00",), ("not hex",), ("",), (None,)], "hash string")
    assert [r[0] for r in df.select(hash_value("hash")).collect()] == ["ab", "ab", "ab", "0", "not hex", "", None]


def test_changed_files(spark):
    s = scans(
        spark, ("/new", "1", 1, 1), ("/same", "0x0A", 5, 1), ("/old-differs", "b", 1, 9), ("/old-differs", "A", 2, 1), ("/tie", "1", 3, 1), ("/tie", "2", 3, 2),
        ("/unreadable-last", "7", 1, 1), ("/unreadable-last", None, 9, 2), ("/never-read", None, 1, 1), (None, "1", 1, 1), ("/same", "0x0A", 5, 1), ("/null-stored", "1", 1, 1),
    )
    d = docs(spark, ("/same", "a"), ("/old-differs", "0a"), ("/tie", "2"), ("/unreadable-last", "8"), ("/gone", "1"), ("/null-stored", None))
    assert sorted(r["path"] for r in changed_files(s, d).collect()) == ["/new", "/null-stored", "/unreadable-last"]
    assert changed_files(s.limit(0), d).count() == 0 and changed_files(s, d.limit(0)).count() == 6


def test_catch_up_takes_each_once(spark, tmp_path):
    s, d = scans(spark, ("/a", "1", 1, 1), ("/b", "2", 1, 2)), docs(spark, ("/b", "2"))
    where = str(tmp_path / "ledger")
    assert [r["path"] for r in catch_up(spark, s, d, where).collect()] == ["/a"]
    assert catch_up(spark, s, d, where).count() == 0
    later = s.unionByName(scans(spark, ("/a", "3", 2, 3)))
    assert [(r["path"], r["hash"]) for r in catch_up(spark, later, d, where).collect()] == [("/a", "3")]


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, hash string")


def test_expired_lease_returns_and_old_token_is_rejected(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1"), ("/b", "2"), (None, "3"), ("/a", "1")))
    slow, items = ledger.lease("slow", 10, now=100.0)
    assert items.count() == 2
    nothing, none = ledger.lease("eager", 10, now=105.0)
    assert none.count() == 0
    fast, again = ledger.lease("fast", 10, now=111.0)
    assert again.count() == 2 and [r[0] for r in again.select("output").orderBy("path").collect()] == [r[0] for r in items.select("output").orderBy("path").collect()]
    with pytest.raises(StaleWriter):
        ledger.complete(slow, items)
    ledger.complete(fast, again.where("path = '/a'"))
    assert {r["path"]: r["state"] for r in ledger.items().collect()} == {"/a": "done", "/b": "leased"}
    # A retried completion of what is done changes nothing.
    ledger.complete(fast, again)
    assert {r["state"] for r in ledger.items().collect()} == {"done"}


def test_two_writers_cannot_make_the_same_commit(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1")))
    with pytest.raises(StaleWriter):
        ledger._publish(ledger.items(), 0)
    assert ledger.version() == 1


def test_newer_content_replaces_what_nobody_began(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1")))
    ledger.enqueue(changes(spark, ("/a", "2")))
    assert [(r["path"], r["hash"]) for r in ledger.items().collect()] == [("/a", "2")]


def test_content_that_comes_back_is_work_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    outputs = []
    for content in ("A", "A", "B", "A"):
        ledger.enqueue(changes(spark, ("/a", content)))
        token, items = ledger.lease("w", 10)
        outputs += [(content, r["output"]) for r in items.collect()]
        ledger.complete(token)
    assert [c for c, _ in outputs] == ["A", "B", "A"] and len({o for _, o in outputs}) == 3


def test_work_that_fails_is_done_again(spark, tmp_path):
    s, d = scans(spark, ("/a", "1", 1, 1)), docs(spark)
    where, seen = str(tmp_path / "ledger"), []

    def fails(items, token):
        seen.extend(r["path"] for r in items.collect())
        raise OSError("the worker died")

    with pytest.raises(OSError):
        catch_up(spark, s, d, where, work=fails, seconds=10, now=100.0)
    assert seen == ["/a"] and catch_up(spark, s, d, where, now=105.0).count() == 0
    assert [r["path"] for r in catch_up(spark, s, d, where, now=111.0).collect()] == ["/a"]
    assert catch_up(spark, s, d, where, now=200.0).count() == 0


def test_outdated_or_unknown_tokens_always_raise(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1"), ("/b", "1")))
    slow, _ = ledger.lease("slow", 10, now=100.0)
    ledger.lease("fast", 10, now=111.0, shard=F.col("path") == "/a")
    before = ledger.version()
    for token in (slow, 99):
        with pytest.raises(StaleWriter):
            ledger.complete(token)
    assert ledger.version() == before
    empty, none = ledger.lease("idle", 10, now=112.0, shard=F.lit(False))
    assert none.count() == 0
    ledger.complete(empty)


def test_newer_content_waits_for_the_lease_of_the_older(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1")))
    ledger.lease("slow", 10, now=100.0)
    ledger.enqueue(changes(spark, ("/a", "2")))
    assert ledger.lease("early", 10, now=105.0)[1].count() == 0
    _, items = ledger.lease("late", 10, now=111.0)
    assert [r["hash"] for r in items.collect()] == ["2"] and ledger.items().count() == 1


def test_a_torn_commit_is_passed_over(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.enqueue(changes(spark, ("/a", "1")))
    (tmp_path / "commit-2.json").write_text("")
    assert ledger.items().count() == 1
    token, items = ledger.lease("w", 10)
    assert token == 3 and items.count() == 1


def test_overtaken_writers_try_again_and_old_files_go(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), fold=3, retain=-5.0)
    publish, left = ledger.heads.publish, [2]

    def overtaken(number, head):
        if left[0]:
            left[0] -= 1
            publish(number, ledger._head()[1])
        publish(number, head)

    ledger.heads.publish = overtaken
    ledger.enqueue(changes(spark, ("/a", "1")))
    assert ledger.version() == 3 and ledger.items().count() == 1
    for n in range(4):
        ledger.enqueue(changes(spark, ("/a", f"b{n}")))
    assert [r["hash"] for r in ledger.items().collect()] == ["b3"]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("items-")]) <= 4


def test_heads_through_the_hadoop_file_system(spark, tmp_path):
    heads = Heads(spark, str(tmp_path), "head")
    heads.local = None
    assert heads.newest() == (-1, None)
    heads.publish(0, {"x": "é" * 100_000})
    with pytest.raises(Overtaken):
        heads.publish(0, {})
    assert heads.newest() == (0, {"x": "é" * 100_000})
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["head-0.json"]
