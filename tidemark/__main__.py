"""python -m tidemark --root FOLDER COMMAND: create, append, query, tables, stats, compact. Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from . import Store, TidemarkError, define_collapsing, define_log, define_summing, define_upsert

MAKERS = {"log": define_log, "upsert": define_upsert, "summing": define_summing, "collapsing": define_collapsing}


def _pairs(text: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in text.split(","))


def _time(value):
    """Numbers below 1e12 are seconds."""
    return int(float(value) * 1000) if isinstance(value, (int, float)) and value < 1e12 else value


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--root", required=True, help="the store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create")
    c.add_argument("name")
    c.add_argument("--columns", required=True, help="ts=delta,value=auto,...")
    c.add_argument("--engine", choices=MAKERS, default="log")
    for x in ("key", "sum", "cluster", "dims"):
        c.add_argument(f"--{x}", type=lambda s: s.split(","))
    for x in ("version", "sign", "retention", "desc"):
        c.add_argument(f"--{x}")
    c.add_argument("--agg", type=_pairs, help="value=avg,...")
    a = sub.add_parser("append")
    a.add_argument("name")
    a.add_argument("rows", nargs="?", help="a JSON row; without it rows are read line by line from standard input")
    sub.add_parser("query").add_argument("sql")
    sub.add_parser("compact").add_argument("name")
    sub.add_parser("tables")
    sub.add_parser("stats")
    return p


def run(spark: SparkSession, argv: list[str]) -> list[dict]:
    args = arguments().parse_args(argv)
    store = Store(spark, args.root)
    if args.command == "create":
        given = {k: v for k, v in vars(args).items() if k in ("key", "sum", "cluster", "dims", "version", "sign", "retention", "desc", "agg") and v is not None}
        store.create(MAKERS[args.engine](args.name, _pairs(args.columns), **given))
        return [{"created": args.name}]
    if args.command == "append":
        lines = [args.rows] if args.rows else [x for x in sys.stdin if x.strip()]
        rows = [json.loads(x) for x in lines]
        return [{"appended": store.open(args.name).append([r | {"ts": _time(r["ts"])} if "ts" in r else r for r in rows])}]
    if args.command == "query":
        out = store.sql(args.sql)
        return [r.asDict(recursive=True) for r in out.toLocalIterator()] if isinstance(out, DataFrame) else [{"inserted": out}]
    if args.command == "compact":
        return [store.open(args.name).compact()]
    return store.describe() if args.command == "tables" else [store.stats()]


def main() -> int:
    spark = SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for row in run(spark, sys.argv[1:]):
            print(json.dumps(row, default=str))
    except TidemarkError as e:
        print(json.dumps({"error": str(e), "code": e.code}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
