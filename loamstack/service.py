"""The engine as a tool server: four verbs that answer in text, over JSON-RPC 2.0 lines on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import IO

from loamstack.engine import Engine
from loamstack.operators.fusion import render
from loamstack.operators.indexer import Options
from loamstack.operators.search import clamp_k

VERSION = "2024-11-05"


def _schema(needed: tuple[str, ...] = (), **kinds: str) -> dict:
    return {"type": "object", "properties": {name: {"type": kind} for name, kind in kinds.items()}, "required": list(needed)}


TOOLS = {
    "search": ("Find the passages of the indexed documents that fit a question.", _schema(("query",), query="string", k="integer")),
    "index": ("Index a folder or a file, or bring its index up to date.", _schema(("path",), path="string", force="boolean")),
    "status": ("Say what is indexed.", _schema()),
    "clear": ("Forget all that is indexed.", _schema()),
}


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    # ---- the verbs ----

    def search(self, query: str, k: int | None = None) -> str:
        """Whole texts of the hits. Without any, what to do about it."""
        hits = render(self.engine.search(query, clamp_k(k)), lines=None).orderBy("rank").collect()
        if hits:
            return "\n\n".join(r["rendered"] for r in hits)
        if self.engine.store.docs().isEmpty():
            return "No results: nothing is indexed yet. Index a folder first."
        return f"No results for: {query}"

    def index(self, path: str, force: bool = False) -> str:
        return self.engine.index(path, options=Options(force=force)).summary()

    def status(self) -> str:
        known = self.engine.status()
        types = ", ".join(f"{ext} {n}" for ext, n in known.pop("by_extension").items())
        return "\n".join([*(f"{name}: {value}" for name, value in known.items()), f"by extension: {types or '-'}"])

    def clear(self) -> str:
        n = self.engine.store.docs().count()
        self.engine.clear()
        return f"cleared {n} documents"

    # ---- the protocol ----

    def answer(self, request: dict) -> dict | None:
        """The answer to a request; None to a notification. A tool that fails answers with its error as text."""
        method, given = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "loamstack", "version": "2"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": name, "description": text, "inputSchema": schema} for name, (text, schema) in TOOLS.items()]}}
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
        name = given.get("name")
        if name not in TOOLS:
            return reply | {"error": {"code": -32602, "message": f"no tool {name}"}}
        try:
            text, failed = getattr(self, name)(**(given.get("arguments") or {})), False
        except Exception as error:  # noqa: BLE001 - the caller is told of any failure
            text, failed = f"{type(error).__name__}: {error}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except (ValueError, AttributeError):
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a request"}}
            if reply is not None:
                sink.write(json.dumps(reply) + "\n")
                sink.flush()
