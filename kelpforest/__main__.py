"""Command line: ``python -m kelpforest sync|index|search|status|explain|chunks|briefing|evaluate|backup|restore|recover|compact``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kelpforest.functions import text as T
from kelpforest.operators import chunking, classify
from kelpforest.plans import evaluate, index, registry
from kelpforest.plans.tools import Tools
from kelpforest.sources.snapshots import export_notes


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kelpforest")
    parser.add_argument("--home", default=".kelpforest", help="folder of the registry and the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("sync", "index"):
        own = commands.add_parser(name)
        own.add_argument("--project", action="append", help="all registered ones, if none is given")
        own.add_argument("--changed", action="store_true", default=name == "sync")
        own.add_argument("--reset", action="store_true")
        own.add_argument("--limit", type=int, help="look at the first files only, and delete nothing")
    own = commands.add_parser("search")
    own.add_argument("query")
    own.add_argument("--in", dest="where", choices=("code", "docs", "memory"), default="code")
    own.add_argument("--project")
    own.add_argument("--limit", type=int, default=6)
    own.add_argument("--expand", action="store_true")
    for name in ("status", "recover", "compact"):
        commands.add_parser(name)
    for name in ("explain", "chunks"):
        own = commands.add_parser(name)
        own.add_argument("path")
        own.add_argument("-v", action="store_true")
    commands.add_parser("briefing").add_argument("project")
    commands.add_parser("evaluate").add_argument("golden", help="JSON: [{project, collection, query, expect}]")
    for name in ("backup", "restore"):
        own = commands.add_parser(name)
        own.add_argument("folder")
        own.add_argument("--name")
        own.add_argument("--dry-run", action="store_true")
    return parser


def _index(tools: Tools, args) -> int:
    with registry.writer_lock(f"{tools.local}/index.lock") as lock:
        if not lock:
            print("another process is indexing")
            return 1
        for p in tools.registry.projects():
            if args.project and p["name"] not in args.project:
                continue
            index.index_project(
                tools.spark, tools.store, p["root"], p["name"], args.changed, ",".join(p["only"]), args.limit or None, tools.embedder, lock.beat, args.reset
            ).show(truncate=False)
    return 0


def _look(spark: SparkSession, args) -> None:
    with open(args.path, "rb") as f:
        content = f.read()
    file = spark.createDataFrame([(args.path, len(content), content)], "path string, size bigint, content binary")
    p = F.col("path")
    seen = file.select(
        "path", classify.skip_reason(p, F.col("size"), F.col("content")).alias("skip_reason"), classify.chunker(p).alias("chunker"), classify.grammar(p).alias("grammar"),
        classify.language(p).alias("language"), classify.doc_type(p).alias("doc_type"), classify.collection(p).alias("collection"), F.col("content").cast("string").alias("text"),
    )
    if args.command == "explain":
        seen.drop("text").show(truncate=False)
    else:
        cut = chunking.chunk(T.redacted(seen).withColumn("key", p))
        cut.select("chunk_index", "start_line", "end_line", "symbol_type", "symbol_name", "heading_path", "content" if args.v else T.preview(F.col("content"), 60).alias("content")).show(1000, truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    os.makedirs(args.home, exist_ok=True)
    tools = Tools(spark, f"file://{os.path.abspath(args.home)}")
    if args.command in ("sync", "index"):
        return _index(tools, args)
    if args.command == "search":
        try:
            if args.where == "memory":
                found = tools.search_memory(args.query, args.project, limit=args.limit)
            else:
                found = (tools.search_code if args.where == "code" else tools.search_docs)(args.query, args.project, limit=args.limit, expand=args.expand)
        except ValueError as e:
            print(e)
            return 1
        found.show(truncate=100)
    elif args.command == "status":
        tools.status().show(truncate=False)
    elif args.command == "recover":
        print("dropped, to be indexed again:", tools.store.recover())
    elif args.command == "compact":
        tools.notes.compact()
        for table in tools.store.current()[1]:
            tools.store.compact(table, everything=True)
        tools.store.expire()
    elif args.command == "evaluate":
        found = evaluate.evaluate(tools, evaluate.golden(tools, args.golden)).collect()
        for r in found:
            print(f"{'with' if r['rerank'] else 'without'} rerank: {r['n']} queries, R@1 {r['r1']}, R@3 {r['r3']}, MRR {r['mrr']}")
        return 0 if found[1]["r3"] >= evaluate.LEAST_R3 else 1
    elif args.command == "briefing":
        print(tools.briefing(args.project))
    elif args.command == "backup":
        print(export_notes(tools.notes.log().drop("dense"), args.folder))
    elif args.command == "restore":
        print(tools.notes.import_backup(args.folder, args.name, args.dry_run))
    else:
        _look(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
