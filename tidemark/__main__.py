"""Command line: ``python -m tidemark convert|query|explain ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import explain
from .plans import workload
from .sources import convert_csv, load_parquet, read_schema, save_tsv
from .sources.files import CODECS, as_text


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert", help="CSV to Parquet")
    c.add_argument("csv")
    c.add_argument("schema", help="a name,type line per column")
    c.add_argument("out")
    c.add_argument("--one-line", action="store_true", help="no field holds a line feed: split large files")
    c.add_argument("--sort-by", nargs="*", help="columns to sort each file by")
    c.add_argument("--compression", choices=CODECS, default="zstd")
    for name, what in (("query", "run a query of the workload"), ("explain", "print its plan")):
        q = commands.add_parser(name, help=what)
        q.add_argument("number", type=int, choices=range(43), metavar="0..42")
        q.add_argument("hits", help="the converted table")
        if name == "query":
            q.add_argument("--out", help="folder for tab-separated result text; printed otherwise")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "convert":
        rows = convert_csv(spark, a.csv, read_schema(spark, a.schema), a.out, multi_line=not a.one_line, sort_by=a.sort_by, compression=a.compression)
        print(f"{rows} rows")
        return 0
    result = workload.build(a.number, load_parquet(spark, a.hits))
    if a.command == "explain":
        print(explain(result))
    elif a.out:
        save_tsv(result, a.out)
    else:
        for row in as_text(result).toLocalIterator():
            print("\t".join(row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
