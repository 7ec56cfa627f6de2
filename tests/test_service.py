"""The tool server, paged extractors, the model slot and the scale probe."""

import io
import json
import sys
import types

import numpy as np
import pytest

from loamstack.cli import probed
from loamstack.engine import Engine
from loamstack.functions import text as columns
from loamstack.operators.embed import OnnxModel
from loamstack.operators.indexer import Options, index_directory
from loamstack.operators.store import Store
from loamstack.service import TOOLS, Service
from loamstack.sources import pages
from loamstack.sources.corpus import NoText


def test_tools(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    service = Service(Engine(spark, str(tmp_path / "store")))
    call = lambda name, **given: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": given}}
    requests = [
        {"jsonrpc": "2.0", "id": 0, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 0, "method": "tools/list"},
        call("search", query="kiln"), call("index", path=str(tmp_path / "corpus")), call("index", path=str(tmp_path / "nowhere")), call("nothing"), {"jsonrpc": "2.0", "id": 2, "method": "other"},
    ]
    sink = io.StringIO()
    service.serve(io.StringIO("".join(json.dumps(r) + "\n" for r in requests) + "no json\n\n"), sink)
    replies = [json.loads(line) for line in sink.getvalue().splitlines()]
    said = [r["result"]["content"][0]["text"] if "content" in r.get("result", {}) else None for r in replies]
    assert [t["name"] for t in replies[1]["result"]["tools"]] == list(TOOLS) == ["search", "index", "status", "clear"]
    assert "Index a folder first" in said[2] and "Nothing to index" in said[3]
    assert replies[4]["result"]["isError"] and [r["error"]["code"] for r in replies[5:]] == [-32602, -32601, -32700]
    (tmp_path / "corpus/kiln.md").write_text("The kiln is fired twice a week.\nAsk the office for the key.")
    assert service.index(str(tmp_path / "corpus")) == "indexed 1, unchanged 0, pruned 0"
    assert service.search("kiln", 99).startswith("[1] ") and "Ask the office" in service.search("kiln")
    assert "documents: 1" in service.status() and "md 1" in service.status()
    assert service.clear() == "cleared 1 documents"


def test_pdf_and_images(spark, tmp_path):
    content = {
        "report.pdf": [pages.Page("The  data-\nbase ﬁle", []), pages.Page(" ", []), pages.Page("Third page", [])], "scan.pdf": [pages.Page("", [b"Invoice 4821"])], "blank.pdf": [pages.Page("", [b"| ."])],
    }

    def reader(path):
        if path.endswith("corrupt.pdf"):
            raise ValueError("not a readable PDF")
        return content[path.rsplit("/", 1)[1]]

    root = tmp_path / "corpus"
    root.mkdir()
    for name in (*content, "corrupt.pdf"):
        (root / name).write_bytes(b"%PDF")
    (root / "bill.png").write_bytes(b"  Bill   17 \n\n due soon")
    (root / "dots.png").write_bytes(b"| . ~ i")
    plain = pages.PdfExtractor(reader=reader)
    assert plain.extract("/report.pdf") == [("The database file", 1), ("Third page", 3)]
    with pytest.raises(NoText):
        plain.extract("/scan.pdf")
    see = lambda image: image.decode()
    extractors = [pages.PdfExtractor(reader=reader, recognise=see), pages.ImageExtractor(recognise=see)]
    store = Store(spark, str(tmp_path / "store"))
    report = index_directory(store, str(root), extractors=extractors)
    assert (report.n_indexed, report.n_failed) == (3, 1)
    found = {(r["path"].rsplit("/", 1)[1], r["text"], r["page"]) for r in store.table("chunks").collect()}
    assert found == {("report.pdf", "The database file", 1), ("report.pdf", "Third page", 3), ("scan.pdf", "Invoice 4821", 1), ("bill.png", "Bill 17\ndue soon", None)}
    # Empty files are looked at again only if asked for.
    content["blank.pdf"] = [pages.Page("Now with text", [])]
    assert index_directory(store, str(root), extractors=extractors).n_indexed == 0
    assert index_directory(store, str(root), extractors=extractors, options=Options(retry_empty=True)).n_indexed == 1
    with pytest.raises(ValueError):
        pages.ImageExtractor()


def test_page_functions_are_those_of_columns(spark):
    texts = ["  The data-\nbase   migra-\ntion plan\n\n\nﬁnal  step\nNext-\nYear", "  Invoice   4821 \n\n  due  soon\n", "", "| . ~ i", "Hello", "a\r\n\r\n\r\nb-\nÉté b-\nété"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in rows.select("t", columns.clean(rows["t"]).alias("clean"), columns.tidy(rows["t"]).alias("tidy"), columns.has_text(rows["t"]).alias("has")).collect():
        assert (pages.clean(row["t"]), pages.tidy(row["t"]), pages.has_text(row["t"])) == (row["clean"], row["tidy"], row["has"])


def test_model_slot_against_a_stub(tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    words = Tokenizer(WordLevel({"[UNK]": 0, "red": 1, "blue": 2, "stone": 3}, unk_token="[UNK]"))
    words.pre_tokenizer = Whitespace()
    words.save(str(tmp_path / "words.json"))

    class Session:
        def __init__(self, model):
            assert model == "model.onnx"

        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"}
            return [np.eye(4)[given["input_ids"]]]

    monkeypatch.setitem(sys.modules, "onnxruntime", types.SimpleNamespace(InferenceSession=Session))
    model = OnnxModel("model.onnx", str(tmp_path / "words.json"), dims=4, max_tokens=3)
    found = model.embed(["red stone", "blue", "red red red blue blue"])
    assert np.allclose(found, [[0, 0.5**0.5, 0, 0.5**0.5], [0, 0, 1, 0], [0, 1, 0, 0]])
    assert model.embed([]).shape == (0, 4) and model.__getstate__()["_loaded"] is None


def test_probe(spark):
    head, row = probed(spark, [50], 2)
    assert head.split(",")[0] == "chunks" and row.startswith("50,") and row.endswith(",2/2")
