"""``python -m pathloom.cli``: import, query, locate, neighbors and status over an index folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .index import Index
from .sources.documents import read_documents


def _questions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Questions from the command line, or the lines of a file."""
    if args.file:
        return spark.read.text(args.file).selectExpr("cast(monotonically_increasing_id() as string) as q", "value as question")
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(args.question)], "q string, question string")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pathloom")
    parser.add_argument("index", help="folder of the index")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("import").add_argument("triples")
    for name in ("query", "locate"):
        own = commands.add_parser(name)
        own.add_argument("question", nargs="*")
        own.add_argument("--file")
        own.add_argument("--mode", default="hybrid")
    commands.add_parser("neighbors").add_argument("node", nargs="+")
    commands.add_parser("documents").add_argument("folder")
    commands.add_parser("status")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    index = Index(spark, args.index)
    if args.command == "import":
        out = index.import_triples(args.triples)
    elif args.command == "query":
        out = index.walk(_questions(spark, args)).where("rank = 1").select("q", "frontier", "path", "confidence")
    elif args.command == "locate":
        out = index.read(index.locate(_questions(spark, args), args.mode))
    elif args.command == "neighbors":
        out = index.neighbors(spark.createDataFrame([(n,) for n in args.node], "node string"))
    elif args.command == "documents":
        out = read_documents(spark, args.folder).selectExpr("doc_id", "title", "length(text) as n_chars")
    else:
        out = index.status()
    out.show(50, truncate=False)


if __name__ == "__main__":
    main()
