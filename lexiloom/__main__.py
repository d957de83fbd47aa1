"""python -m lexiloom import|index|search: the engine from the command line, with the stores that the settings name."""
from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lexiloom import settings
from lexiloom.operators import search
from lexiloom.operators.ingest import BOOK_TITLE
from lexiloom.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiloom")
    top.add_argument("--settings", default=".env", help="file of KEY=VALUE lines")
    steps = top.add_subparsers(dest="step", required=True)
    take = steps.add_parser("import", help="append an aligned CSV to the relational store and rebuild the lexicon")
    take.add_argument("csv")
    take.add_argument("--title", default=BOOK_TITLE)
    take.add_argument("--author")
    take.add_argument("--year", type=int)
    index = steps.add_parser("index", help="write an aligned CSV's pairs as search documents")
    index.add_argument("csv")
    index.add_argument("--keep", action="store_true", help="update the documents there instead of starting anew")
    ask = steps.add_parser("search", help="print the JSON response of a query")
    ask.add_argument("q")
    ask.add_argument("--lang", default=search.DEFAULT_LANG)
    ask.add_argument("--limit", type=int, default=search.DEFAULT_LIMIT)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What the command prints."""
    at = settings.load(args.settings)
    if args.step == "import":
        docs = files.import_csv(spark, args.csv)
        books = files.write_store(docs, at.store_path, args.title, args.author, args.year, args.csv)
        entries = files.write_lexicon(files.read_store(spark, at.store_path), at.store_path)
        return f"books {books[0]} and {books[1]}, {docs.count()} pairs, {entries} lexicon entries"
    if args.step == "index":
        written, errors = files.write_documents(files.import_csv(spark, args.csv, "search"), at.documents, keep=args.keep)
        return "\n".join([f"{written} documents", *(json.dumps(e, ensure_ascii=False) for e in errors)])
    asked = spark.createDataFrame([(1, args.q, args.lang, args.limit)], "query_id int, q string, lang string, limit int")
    return search.responses(asked, search.search(asked, files.read_documents(spark, at.documents))).first().response


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main()
