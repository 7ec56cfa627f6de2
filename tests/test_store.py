"""The store and incremental indexing, by the scenarios users meet."""

import os

import pytest

from loamstack.engine import Engine
from loamstack.operators.indexer import Options, index_directory, index_one, index_table
from loamstack.operators.ledger import StaleWriter
from loamstack.operators.store import FAN, Store, due
from loamstack.sources import corpus
from loamstack.streaming.ingest import ingest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "rust_errors.md").write_text("Borrow rules.\n\nE0382 is a use of a moved value.\n\nLifetimes come third.")
    (root / "deploy.txt").write_text("How to deploy the service with containers.")
    return root


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_pipeline(spark, tmp_path, tree):
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.status()["documents"] == 0 and engine.search("anything").collect() == []
    events = []
    assert str(engine.index(str(tree), progress=lambda kind, _: events.append(kind))) == "indexed 2, unchanged 0, pruned 0"
    assert events == ["discovered", "scanned", "embedding", "embedding", "finished"]
    hit = engine.search("what about E0382").orderBy("rank").first()
    assert hit["path"].endswith("rust_errors.md") and hit["rank"] == 1 and hit["score"] == 1.0
    assert str(engine.index(str(tree))) == "indexed 0, unchanged 2, pruned 0"
    # A touched file of the same content keeps its chunks; the flag asks for the stricter reading.
    os.utime(tree / "deploy.txt", (1, 1))
    assert str(engine.index(str(tree))) == "indexed 0, unchanged 2, pruned 0"
    os.utime(tree / "deploy.txt", (2, 2))
    assert str(engine.index(str(tree), options=Options(strict_stat=True))) == "indexed 1, unchanged 1, pruned 0"
    (tree / "deploy.txt").unlink()
    assert str(engine.index(str(tree), options=Options(no_prune=True))) == "indexed 0, unchanged 1, pruned 0"
    assert str(engine.index(str(tree))) == "indexed 0, unchanged 1, pruned 1"
    before = [tuple(r) for r in engine.search("lifetimes").collect()]
    engine.store.compact()
    assert len(engine.store.manifest.segments) == 1 and [tuple(r) for r in engine.search("lifetimes").collect()] == before
    engine.clear()
    assert engine.status()["chunks"] == 0 and engine.store.schema_matches()


def test_prune_stays_under_the_root(spark, tmp_path):
    a, b = tmp_path / "root", tmp_path / "root-b"
    write(a / "a.md", "first document text")
    write(b / "b.md", "second document text")
    store = Store(spark, str(tmp_path / "s"))
    index_directory(store, str(a))
    assert index_directory(store, str(b)).removed_missing == 0
    (b / "b.md").unlink()
    write(b / "c.md", "third document text")
    assert index_directory(store, str(b)).removed_missing == 1
    assert sorted(os.path.basename(r["path"]) for r in store.docs().collect()) == ["a.md", "c.md"]


def test_walk(tmp_path):
    root = tmp_path / ".notes"
    for name in ("note.md", ".hidden/x.md", "node_modules/x.md", "_dir/_x.md", "big.md", "Makefile", ".env", "empty.md", "pic.png"):
        write(root / name, "" if name == "empty.md" else "text")
    (root / "big.md").write_bytes(b"x" * (corpus.MAX_FILE_BYTES + 1))
    (tmp_path / "real").mkdir()
    write(tmp_path / "real/linked.md", "text")
    (root / "link").symlink_to(tmp_path / "real")
    names = [os.path.relpath(f.path, root) for f in corpus.discover(str(root))]
    assert names == ["Makefile", "_dir/_x.md", "empty.md", "link/linked.md", "note.md"]
    (root / "loop").symlink_to(root)
    with pytest.raises(corpus.WalkError):
        corpus.discover(str(root))
    (root / "loop").unlink()
    (root / "broken").symlink_to(tmp_path / "nowhere")
    with pytest.raises(corpus.WalkError):
        corpus.discover(str(root))


def test_extractors_empty_and_failing_files(spark, tmp_path, tree):
    def backwards(path):
        data = open(path, "rb").read()
        if data == b"none":
            raise corpus.NoText
        if data == b"bad":
            raise ValueError("unreadable")
        return [(data.decode()[::-1], 3)]

    custom = [corpus.Extractor(("fake",), lambda p: []), corpus.Extractor(("FAKE",), backwards)]
    write(tree / "scan.fake", "prolgxyz drow eht")
    write(tree / "blank.fake", "none")
    write(tree / "bad.fake", "bad")
    store = Store(spark, str(tmp_path / "s"))
    report = index_directory(store, str(tree), extractors=custom)
    assert (len(report.indexed), report.failed) == (3, [str(tree / "bad.fake")])
    assert {os.path.basename(r["path"]): r["n_chunks"] for r in store.docs().collect()} == {"blank.fake": 0, "scan.fake": 1, "rust_errors.md": 1, "deploy.txt": 1}
    assert store.table("chunks").where("text like '%zyxglorp%'").first()["page"] == 3
    assert str(index_directory(store, str(tree), extractors=custom)) == "indexed 0, unchanged 4, pruned 0, failed 1"
    write(tree / "blank.fake", "none")
    again = index_directory(store, str(tree), extractors=custom, options=Options(retry_empty=True))
    assert again.skipped_unchanged == 3
    # What is excluded now but still exists is kept.
    assert index_directory(store, str(tree)).removed_missing == 0


def test_index_one_and_identity(spark, tmp_path, tree, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    write(tree / "odd.xyz", "a file of an unlisted kind")
    assert index_one(store, str(tree / "odd.xyz")) == 1
    write(tree / "empty.md", "")
    with pytest.raises(ValueError):
        index_one(store, str(tree / "empty.md"))
    monkeypatch.chdir(tmp_path)
    index_directory(store, "corpus")
    assert index_directory(store, str(tree)).skipped_unchanged == 3
    with pytest.raises(NotADirectoryError):
        index_directory(store, str(tree / "deploy.txt"))


def test_decode():
    assert corpus.decode(b"\xef\xbb\xbfok") == "ok" and corpus.decode(b"a\xff") == "a�"
    with pytest.raises(UnicodeDecodeError):
        corpus.decode(b"\xef\xbb\xbf\xff")


def test_alignment_and_upsert(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(f"/d{i}", "h", 0, 1) for i in range(4)], "path string, content_hash string, mtime_secs long, size long")
    chunks = spark.createDataFrame([(f"/d{i}", 0, f"marker{i} text", None) for i in reversed(range(4))], "path string, ordinal int, text string, page int")
    vectors = spark.createDataFrame([(f"/d{i}", 0, [float(i == j) for j in range(4)]) for i in range(4)], "path string, ordinal int, embedding array<double>")
    store.upsert(docs, chunks, vectors=vectors)
    joined = store.table("chunks").join(store.table("vectors"), ["chunk_key", "path"]).collect()
    assert all(r["embedding"].index(1.0) == int(r["text"][6]) for r in joined) and sorted(r["chunk_key"] for r in joined) == [0, 1, 2, 3]
    store.upsert(docs.where("path = '/d1'"), chunks.where("path = '/d1'").selectExpr("path", "ordinal", "'new text here' text", "page"), vectors=vectors)
    assert store.next_chunk_key() == 5 and store.table("chunks").where("path = '/d1'").first()["text"] == "new text here"
    assert store.stats().first().asDict() == {"documents": 4, "chunks": 4, "total_source_bytes": 4}
    assert store.delete(spark.createDataFrame([("/d0",), ("/nope",)], "path string")) == 1
    assert Store(spark, str(tmp_path / "s")).stats().first()["documents"] == 3


def test_stale_writer_is_refused(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.clear()
    with pytest.raises(StaleWriter):
        two.clear()
    assert two.refresh().manifest.version == 1


def test_many_documents(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(129):
        write(root / f"doc{i:03}.md", f"source marker {i} exact document content")
    store = Store(spark, str(tmp_path / "s"))
    assert len(index_directory(store, str(root)).indexed) == 129
    assert all(f" {int(r['path'][-6:-3])} " in r["text"] for r in store.table("chunks").collect())


def test_table_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("/a", "one document here"), ("/b", None), (None, "lost"), ("/a", "one document here")], "path string, text string")
    assert index_table(store, rows) == 2 and index_table(store, rows) == 0
    rows.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("/c", "another document here")], "path string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "check")).awaitTermination()
    assert {r["path"] for r in store.refresh().docs().collect()} == {"/a", "/b", "/c"}


def test_two_thousand_segments_and_a_torn_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = [f"segment-{i:032x}" for i in range(2_000)]
    store._publish(7, names, [0] * 2_000)
    assert Store(spark, str(tmp_path)).manifest.segments == names
    # A writer that died while it wrote leaves nothing of its own, and what an older one left torn is passed over.
    (tmp_path / "manifest-2.json").write_text('{"version": 2, "segm')
    (tmp_path / ".manifest-3-abc").write_text("{")
    again = Store(spark, str(tmp_path))
    assert again.next_chunk_key() == 7
    again.clear()
    assert again.manifest.version == 3 and Store(spark, str(tmp_path)).manifest.segments == []


def test_segments_are_merged_by_level(spark, tmp_path):
    levels = []
    for _ in range(FAN**3 - 1):
        levels.append(0)
        while n := due(levels):
            levels[-n:] = [levels[-1] + 1]
    assert len(levels) == 3 * (FAN - 1) and levels == sorted(levels, reverse=True)
    store = Store(spark, str(tmp_path))
    row = "path string, content_hash string, mtime_secs long, size long"
    for i in range(FAN + 1):
        docs = spark.createDataFrame([(f"/d{i % 5}", f"h{i}", 0, 1)], row)
        store.upsert(docs, spark.createDataFrame([(f"/d{i % 5}", 0, f"text number{i} here")], "path string, ordinal int, text string"))
        if i == 3:
            store.delete(spark.createDataFrame([("/d1",)], "path string"))
    assert store.manifest.levels == [1, 0, 0]
    assert {r["path"]: r["content_hash"] for r in store.docs().collect()} == {"/d0": "h5", "/d1": "h6", "/d2": "h7", "/d3": "h8", "/d4": "h4"}
    assert {r["term"] for r in store.table("postings").where("term like 'number%'").collect()} == {f"number{i}" for i in range(4, 9)}
    assert store.intact() and not store.repair()
    segments = {p.name for p in tmp_path.iterdir() if p.name.startswith("segment-")}
    assert store.vacuum(retain=-5.0) > 0
    assert {p.name for p in tmp_path.iterdir() if p.name.startswith("segment-")} == set(store.manifest.segments) < segments
    # A damaged keyword table is made anew.
    for file in (tmp_path / store.manifest.segments[0] / "postings").glob("*.parquet"):
        file.write_bytes(b"damaged")
    for file in (tmp_path / store.manifest.segments[0] / "postings").glob(".*.crc"):
        file.unlink()
    assert store.repair() and store.table("postings").where("term = 'number8'").count() == 1


def test_progress_tells_of_each_window_and_file(spark, tmp_path):
    for i in range(129):
        write(tmp_path / f"many/doc{i:03}.md", f"source marker {i} exact document content")
    told, files = [], []
    index_directory(
        Store(spark, str(tmp_path / "s")), str(tmp_path / "many"),
        progress=lambda kind, what: told.append((what["done"], what["total"])) if kind == "embedding" else None, each=lambda *file: files.append(file),
    )
    assert told == [(0, 129), (128, 129), (129, 129)]
    assert len(files) == 129 and files[-1][1:] == (129, 129)


def test_a_tree_given_by_uri(spark, tmp_path):
    root = tmp_path / "corpus"
    for name in ("a.md", "deep/b.txt", ".hidden/x.md", "node_modules/x.md", "pic.png", "Makefile"):
        write(root / name, f"document called {name}")
    (root / "bad.md").write_bytes(corpus.BOM + b"\xff")
    write(root / "empty.md", " ")
    uri = f"file://{root}"
    store = Store(spark, str(tmp_path / "s"))
    report = index_directory(store, uri)
    assert (report.indexed, report.failed) == ([f"{uri}/Makefile", f"{uri}/a.md", f"{uri}/deep/b.txt"], [f"{uri}/bad.md"])
    assert "failed: " in report.summary()
    (root / "a.md").unlink()
    assert str(index_directory(store, uri)) == "indexed 0, unchanged 3, pruned 1, failed 1"
