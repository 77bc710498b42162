"""python -m tidemark query NAME --dir TABLES [--out FOLDER], or: strategy NAME --dir TABLES --kind metrics."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    query = sub.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name")
    plan = sub.add_parser("strategy", help="analyse a strategy over the folder's bars")
    plan.add_argument("name")
    plan.add_argument("--kind", default="metrics", choices=["metrics", "insample", "walkforward", "both"])
    for p in (query, plan):
        p.add_argument("--dir", required=True)
        p.add_argument("--out", help="write Parquet here instead of printing rows")
    args = parser.parse_args(argv)

    from tidemark.operators.strategy import REGISTRY
    from tidemark.operators.validate import analyse
    from tidemark.plans import data_queries, reference_queries
    from tidemark.session import get_spark

    spark = get_spark()
    if args.command == "query":
        frames = {args.name: (data_queries.QUERIES | reference_queries.QUERIES)[args.name](spark, args.dir)}
    else:
        frames = analyse(reference_queries.bars(spark, args.dir), reference_queries.S, REGISTRY.get(args.name), args.kind)
    for name, df in frames.items():
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            df.show(truncate=False)


if __name__ == "__main__":
    main()
