"""Command line: python -m corvane ingest|evaluate|search|answer|serve|verify|export|repair|rebuild|pack|unpack."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corvane import storage
from corvane.api import Service, server
from corvane.engine import Engine, Settings
from corvane.operators import bundle, evaluate, models
from corvane.sources import files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--home", required=True, help="folder of the index; all executors must see it")
    parser.add_argument("--embedding", help="provider of vectors")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("folder")
    ingest.add_argument("--artifacts-dir")
    ingest.add_argument("--rebuild", action="store_true", help="read all files again")
    assess = commands.add_parser("evaluate")
    assess.add_argument("questions", help="JSON array of questions with answers")
    assess.add_argument("--report-json")
    for name in ("search", "answer"):
        ask = commands.add_parser(name)
        ask.add_argument("query")
        ask.add_argument("--top-k", type=int, default=4, choices=range(1, 11))
        ask.add_argument("--model-filter", default="")
    serve = commands.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    commands.add_parser("verify").add_argument("--report-json")
    export = commands.add_parser("export")
    export.add_argument("folder")
    export.add_argument("--by-type", action="store_true")
    export.add_argument("--source", choices=("store", "lexical"), default="store")
    commands.add_parser("repair").add_argument("folder")
    build = commands.add_parser("rebuild")
    build.add_argument("artifacts")
    build.add_argument("--include-export-new", action="store_true")
    build.add_argument("--allow-bm25", action="store_true")
    build.add_argument("--dry-run", action="store_true")
    build.add_argument("--report-json")
    commands.add_parser("pack").add_argument("bundle")
    unpack = commands.add_parser("unpack")
    unpack.add_argument("bundle")
    unpack.add_argument("--force", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    """Run one command; verify returns 2 if the index fails, unpack 3 if its settings differ."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    engine = Engine(spark, args.home, Settings(embedding=args.embedding))
    if args.command == "ingest":
        engine.ingest_all(args.folder, args.artifacts_dir, not args.rebuild).groupBy("status", "action").count().show()
    elif args.command in ("search", "answer"):
        asked = spark.createDataFrame([(1, "cli", args.query, args.model_filter or None)], "query_id long, user_id string, query string, facet string")
        if args.command == "search":
            engine.contexts(engine.search(asked, args.top_k)).show(truncate=False)
        else:
            engine.answer(asked, args.top_k).select("answer", "status").show(truncate=False)
    elif args.command == "serve":
        server(Service(engine), args.host, args.port).serve_forever()
    elif args.command == "evaluate":
        rows = models.judged(files.evaluation_set(spark, args.questions), models.extractive_generator)
        rows = storage.settle(rows.selectExpr("*", "cast(null as string) AS error"), "judged")
        bundle.write_results(rows, f"{args.home}/metadata/evaluation")
        report = evaluate.report(rows)
        report.show(truncate=False)
        if args.report_json:
            bundle.write_report(report, args.report_json)
    elif args.command == "verify":
        report = engine.verify()
        if args.report_json:
            bundle.write_report(report, args.report_json)
        report.show(truncate=False)
        return 2 if report.where("status = 'fail'").count() else 0
    elif args.command == "export":
        print(engine.export(args.folder, args.by_type, args.source).count())
    elif args.command == "repair":
        engine.repair_jsonl(args.folder).groupBy("status").count().show()
    elif args.command == "rebuild":
        report = storage.settle(engine.rebuild(args.artifacts, args.include_export_new, args.allow_bm25, args.dry_run), "report")
        report.show(truncate=False, vertical=True)
        if args.report_json:
            bundle.write_report(report, args.report_json)
    elif args.command == "pack":
        print(engine.pack(args.bundle))
    else:
        differ = engine.unpack(args.bundle, args.force)
        print("settings differ: " + ", ".join(differ) if differ else "settings fit")
        return 3 if differ else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
