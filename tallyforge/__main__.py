"""Commands: queries, judgement tables, conventions, ingest, cost and the frozen schema."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime


def _session(args):
    from .session import build_session

    return build_session(master=args.master)


def _query(args) -> int:
    from .plans.registry import QUERIES

    if not args.names:
        print("\n".join(sorted(QUERIES)))
        return 0
    unknown = set(args.names) - set(QUERIES)
    if unknown:
        print(f"unknown: {', '.join(sorted(unknown))}", file=sys.stderr)
        return 2
    spark = _session(args)
    for name in args.names:
        rows = QUERIES[name](spark, args.sf)
        if args.out:
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            rows.show(20, truncate=80)
    return 0


def _tables(args) -> int:
    from .plans import publication, reports
    from .sources.readers import judgement_rows

    rows = judgement_rows(_session(args), args.judgements)
    tables = publication.build_all(rows, judges=tuple(args.judges), n_boot=args.n_boot)
    if args.out:
        print("\n".join(publication.write_all(tables, args.out)))
    else:
        print(reports.judging_report(rows) + "\n" + reports.tables_report(tables))
    return 0


def _conventions(args) -> int:
    from .operators.conventions import convention_tables
    from .plans import publication, reports
    from .sources.readers import corpus

    tables = convention_tables(corpus(_session(args), args.folder))
    if args.out:
        publication.write_all(tables, args.out)
    print(reports.conventions_report(tables["convention_stats"]))
    return 0


def _ingest(args) -> int:
    from pyspark.sql import functions as F

    from .plans import reports
    from .sources.ingest import extract_files, ingest, read_files
    from .sources.readers import read_manifest

    spark = _session(args)
    manifest = read_manifest(spark, args.manifest).withColumn("_seq", F.monotonically_increasing_id())
    done = ingest(manifest, extract_files(read_files(spark, args.folder)), min_chars=args.min_chars)
    if args.out:
        done.write.mode("overwrite").parquet(args.out)
    why = F.when(F.col("reason") == "", "admitted").otherwise(F.regexp_replace("reason", r"[:(].*| of .*", ""))
    print(reports.titled("Ingest", reports.grid(done.groupBy(why.alias("outcome")).count().orderBy("outcome"))))
    return 0


def _cost(args) -> int:
    from .operators.requests import estimate
    from .plans import reports

    spark = _session(args)
    requests = spark.read.json(args.requests)
    prices = spark.read.option("header", True).schema("prefix string, usd_in double, usd_out double").csv(args.prices)
    print(reports.cost_report(estimate(requests, prices), args.limit))
    return 0


def _freeze(args) -> int:
    from .sources.readers import slots
    from .sources.sinks import freeze_schema, schema_problems

    rows = slots(args.slots)
    if problems := schema_problems(rows):
        print(json.dumps(problems, indent=2), file=sys.stderr)
        return 1
    if args.check:
        print(f"{len(rows)} slots, no problems")
        return 0
    print(freeze_schema(args.out, rows, args.by, args.at or datetime.now(UTC).date().isoformat()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, about: str):
        one = commands.add_parser(name, help=about)
        one.set_defaults(run=run)
        return one

    one = command("query", _query, "list the queries, or run some and show or write their rows")
    one.add_argument("names", nargs="*")
    one.add_argument("--sf", default="/root/testdata/sf0.001", help="folder of the input tables")
    one.add_argument("--out", help="folder for Parquet results; without it twenty rows are shown")
    one = command("tables", _tables, "publication tables from judgement files")
    one.add_argument("judgements")
    one.add_argument("--judges", nargs=2, required=True)
    one.add_argument("--n-boot", type=int, default=200)
    one.add_argument("--out")
    one = command("conventions", _conventions, "writing conventions of the reports below a folder")
    one.add_argument("folder")
    one.add_argument("--out")
    one = command("ingest", _ingest, "admit saved reports by a manifest")
    one.add_argument("manifest")
    one.add_argument("folder")
    one.add_argument("--min-chars", type=int, default=200)
    one.add_argument("--out")
    one = command("cost", _cost, "projected cost of requests in JSON lines")
    one.add_argument("requests")
    one.add_argument("prices")
    one.add_argument("--limit", type=float)
    one = command("freeze", _freeze, "check a slot schema, or freeze it with who approved it")
    one.add_argument("slots")
    one.add_argument("--out", default="schema.yaml")
    one.add_argument("--by", default="")
    one.add_argument("--at")
    one.add_argument("--check", action="store_true")
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
