"""Command line: list, explain or run registered queries.

    python -m codelens list
    python -m codelens run judge_report --data /root/testdata/sf0.1 --out /path/out [--format csv]
    python -m codelens explain tfidf_terms --data /root/testdata/sf0.01
    python -m codelens sql <name>            # print the SQL oracle of a query
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="codelens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain", "sql"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--data", default="/root/testdata/sf0.01")
        p.add_argument("--out")
        p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
        p.add_argument("--master")
    args = ap.parse_args(argv)

    from codelens.plans import catalog

    catalog.load_all()
    if args.cmd == "list":
        for n in sorted(catalog.QUERIES):
            print(f"{n}\t{'sql' if n in catalog.ORACLE else 'rows-only'}")
        return 0
    if args.query not in catalog.QUERIES:
        print(f"unknown query {args.query}", file=sys.stderr)
        return 2
    if args.cmd == "sql":
        print(catalog.ORACLE.get(args.query, "-- no SQL oracle (seeded ML job)"))
        return 0

    from codelens.session import get_spark
    from codelens.sources.io import write_table

    spark = get_spark(args.master)
    df = catalog.QUERIES[args.query](spark, args.data)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        write_table(df, args.out, args.format)
    else:
        df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
