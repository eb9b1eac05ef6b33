"""Command line: ``python -m pathlens build --raw DIR --out DIR [--as-of TS] [--database DB]``."""

from __future__ import annotations

import argparse
import datetime as dt


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pathlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="raw CSV -> cleaned, derived and warehouse tables")
    b.add_argument("--raw", required=True, help="folder with customers.csv and interactions.csv")
    b.add_argument("--out", required=True, help="output folder for Parquet tables")
    b.add_argument("--as-of", default=None, help="'now' for recency (default: current time)")
    b.add_argument("--database", default=None, help="also load catalog tables into this database")
    b.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    args = p.parse_args(argv)

    from .plans.batch import build_warehouse
    from .session import build_session
    spark = build_session(args.master)
    as_of = args.as_of or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    tables = build_warehouse(spark, args.raw, args.out, as_of, database=args.database)
    for name in sorted(tables):
        print(name, args.out)


if __name__ == "__main__":
    main()
