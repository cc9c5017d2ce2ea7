"""Command line: capture a table of pages, query chunks, convert files, check the environment."""

from __future__ import annotations

import argparse
import json
import sys


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrivane", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("capture", help="pages (page_id, url, html) to Markdown, chunks, assets and a manifest")
    c.add_argument("pages")
    c.add_argument("output")
    q = sub.add_parser("query", help="a page of the chunks that contain a text")
    q.add_argument("chunks")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=20)
    q.add_argument("--offset", type=int, default=0)
    f = sub.add_parser("convert", help="files of the registered kinds to Markdown")
    f.add_argument("files")
    f.add_argument("output")
    sub.add_parser("doctor", help="what this environment has")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from scrivane.operators.reading import Library, query_chunks
    from scrivane.sources.readers import documents

    spark = SparkSession.builder.master(args.master).appName("scrivane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "capture":
        for name, df in Library(spark).capture(spark.read.parquet(args.pages)).items():
            df.write.mode("overwrite").parquet(f"{args.output}/{name}")
    elif args.command == "query":
        for row in query_chunks(spark.read.parquet(args.chunks), args.text, args.limit, args.offset, ("page_id", "chunk_id")).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
    elif args.command == "convert":
        documents(spark, args.files).write.mode("overwrite").parquet(args.output)
    else:
        checks = Library(spark).doctor().collect()
        for c in checks:
            print(f"{c['check']}: {'ok' if c.passed else 'missing'} ({c.need})")
        return int(any(c.need == "required" and not c.passed for c in checks))
    return 0


if __name__ == "__main__":
    sys.exit(main())
