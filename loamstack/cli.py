"""Command line: ``python -m loamstack.cli index PATH``, ``search QUERY``, ``status``, ``clear``, ``serve``, ``bench``, ``probe``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loamstack.engine import Engine
from loamstack.operators.fusion import render
from loamstack.operators.indexer import Options, index_table
from loamstack.service import Service
from loamstack.session import make_session, scratch


def probed(spark: SparkSession, sizes: list[int], n: int) -> Iterator[str]:
    """Lines of a table: for each size of a made-up corpus, the time of indexing and of lone queries of 5 hits.

    One chunk a document, each with a token of its own; every query asks for one such token, and must find it first.
    """
    yield "chunks,index_s,mean_s,p50_s,p95_s,found"
    for size in sizes:
        engine = Engine(spark, scratch(spark, "probe"))
        rows = spark.range(size).select(F.format_string("doc%d.txt", "id").alias("path"), F.format_string("subject token zz%08x of the retrieval benchmark", "id").alias("text"))
        began = time.perf_counter()
        index_table(engine.store, rows)
        took, times, found = time.perf_counter() - began, [], 0
        for i in range(n + 1):
            at = i * 7919 % size
            began = time.perf_counter()
            hits = engine.search(f"subject token zz{at:08x} retrieval benchmark", 5).collect()
            times.append(time.perf_counter() - began)
            found += i > 0 and min(hits, key=lambda h: h["rank"])["path"] == f"doc{at}.txt"
        kept = sorted(times[1:])
        yield f"{size},{took:.2f},{sum(kept) / n:.3f},{kept[n // 2]:.3f},{kept[min(n - 1, int(n * 0.95))]:.3f},{found}/{n}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loamstack")
    parser.add_argument("--data-dir")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path")
    index.add_argument("-e", "--extensions", default="")
    index.add_argument("--force", action="store_true")
    index.add_argument("--no-prune", action="store_true")
    index.add_argument("--retry-empty", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=5)
    bench = commands.add_parser("bench")
    bench.add_argument("-n", type=int, default=10)
    probe = commands.add_parser("probe")
    probe.add_argument("-s", "--sizes", default="1000,5000,10000,25000,50000")
    probe.add_argument("-n", type=int, default=15)
    commands.add_parser("serve")
    commands.add_parser("status")
    commands.add_parser("clear")
    args = parser.parse_args(argv)

    if args.command == "probe":
        for row in probed(make_session(), [int(n) for n in args.sizes.split(",")], args.n):
            print(row, flush=True)
        return 0
    engine = Engine(make_session(), args.data_dir)
    if args.command == "serve":
        Service(engine).serve()
        return 0
    if args.command == "index":
        report = engine.index(args.path, [e for e in args.extensions.split(",") if e], Options(args.no_prune, args.force, args.retry_empty))
        print(report.summary())
        return 1 if report.n_failed else 0
    if args.command == "search":
        hits = [r["rendered"] for r in render(engine.search(args.query, args.k)).orderBy("rank").collect()]
        print("\n\n".join(hits) if hits else "(no results)")
    elif args.command == "status":
        for name, value in engine.status().items():
            print(f"{name}: {value}")
    elif args.command == "clear":
        engine.clear()
    elif args.command == "bench":
        times = []
        for _ in range(args.n + 1):
            began = time.time()
            engine.search("how is the index rebuilt after a change", 5).collect()
            times.append(time.time() - began)
        kept = sorted(times[1:])
        print(f"n {len(kept)}, mean {sum(kept) / len(kept):.3f} s, p50 {kept[len(kept) // 2]:.3f} s, p95 {kept[int(len(kept) * 0.95)]:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
