"""Command line: ``python -m docloom.cli ingest|query|create|health|vacuum|parse|chunk``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from docloom.config import Settings
from docloom.operators.chunking import chunk_segments
from docloom.plans import pipeline
from docloom.sources import files
from docloom.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom")
    top.add_argument("--store", default="docloom-store", help="folder of the tables")
    top.add_argument("--dense-size", type=int, default=Settings.from_env().dense_vector_size)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("ingest", "parse", "chunk"):
        one = verbs.add_parser(verb)
        one.add_argument("path", help="a file or a folder")
        one.add_argument("--chat", default=None)
        one.add_argument("--chat-name", default=None)
    ask = verbs.add_parser("query")
    ask.add_argument("question", nargs="+")
    ask.add_argument("--top-k", type=int, default=5)
    ask.add_argument("--chat", default=None)
    ask.add_argument("--file", action="append", default=None)
    verbs.add_parser("create")
    verbs.add_parser("health")
    verbs.add_parser("vacuum")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    settings = Settings.from_env()
    store = Store(spark, args.store, pipeline.POINTS, args.dense_size)
    if args.verb == "create":
        print("created" if store.ensure() else "already there", store.summary())
    elif args.verb == "vacuum":
        print("deleted versions:", store.vacuum())
    elif args.verb == "health":
        state = store.health()
        print(state)
        return 0 if all(state.values()) else 1
    elif args.verb == "query":
        questions = spark.createDataFrame([(0, " ".join(args.question))], "query_id long, question string")
        for hit in pipeline.search_documents(store, questions, args.top_k, args.chat, args.file, settings=settings).orderBy("pos").collect():
            print(f"[{hit['pos']}] {hit['rrf']:.4f} {hit['file_path']}\n{hit['text']}\n")
    else:
        found = files.list_files(spark, args.path)
        if found.isEmpty():
            raise SystemExit(f"No supported files found. Supported types: {', '.join(files.SUPPORTED_SUFFIXES)}")
        if args.verb == "ingest":
            print(pipeline.ingest(store, found, args.chat, args.chat_name, settings=settings))
        else:
            segments, errors = files.parse_files(found, settings=settings)
            rows = segments if args.verb == "parse" else chunk_segments(segments, settings=settings)
            for row in rows.orderBy("source_segment").collect():
                print(row["file_name"], row["source_type"], repr(row["text"][:200]))
            for row in errors.collect():
                print("error", row["path"], row["error"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
