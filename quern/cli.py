"""Command line: ``index``, ``query``, ``serve``, ``dataset`` and ``eval``.

``index`` and ``query`` take documents from a folder or a JSON-lines corpus; with ``--store`` the
index stays there, and ``query`` works on it without documents.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quern.plans.config import variant
from quern.plans.evaluate import sweep
from quern.plans.pipeline import Pipeline
from quern.service import Service
from quern.sources import corpus
from quern.sources.files import markdown, read_corpus, read_directory, read_questions, read_unanswerable, write_report


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("--config", help="a JSON file")
    parser.add_argument("--store", help="a folder that keeps the index")
    what = parser.add_subparsers(dest="what", required=True)
    for name in ("index", "query", "serve"):
        sub = what.add_parser(name)
        sub.add_argument("--path")
        sub.add_argument("--corpus")
        if name == "query":
            sub.add_argument("question")
        if name == "serve":
            sub.add_argument("--port", type=int, default=8080)
    for name in ("dataset", "eval"):
        sub = what.add_parser(name)
        sub.add_argument("directory")
        if name == "eval":
            sub.add_argument("--out", help="a file for the report as JSON")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.what == "dataset":
        print(json.dumps(corpus.write(args.directory)))
        return 0
    given = {}
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            given = json.load(f)
    spark = SparkSession.builder.getOrCreate()
    if args.what == "eval":
        d = args.directory
        report = sweep(spark, given, read_corpus(spark, f"{d}/corpus.jsonl"), read_questions(spark, f"{d}/questions.jsonl"), read_unanswerable(spark, f"{d}/unanswerable.jsonl"))
        print("\n\n".join(markdown(rows) for rows in report.values()))
        if args.out:
            write_report(report, args.out)
        return 0
    docs = read_directory(spark, args.path) if args.path else read_corpus(spark, args.corpus) if args.corpus else None
    with Pipeline(spark, variant(given, store={"path": args.store} if args.store else {})) as pipeline:
        if docs is not None and not docs.isEmpty():
            print(json.dumps(pipeline.index(docs)))
        elif args.what == "index" or pipeline.tables.current() == 0 and args.what == "query":
            print("nothing to index", file=sys.stderr)
            return 1
        if args.what == "query":
            print(json.dumps(pipeline.query(args.question), ensure_ascii=False))
        if args.what == "serve":
            from wsgiref.simple_server import make_server

            make_server("", args.port, Service(pipeline)).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
