"""Command line: registered queries, configurations, local corpora, mock runs, run stages over a run folder, audits."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("lacuna").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lacuna")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    run = sub.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it twenty rows are shown")
    check = sub.add_parser("validate-config")
    check.add_argument("paths", nargs="+")
    for name, wants in {
        "init-example": ("folder",), "smoke-test": ("config", "run"), "prepare-local-corpus": ("config", "out"), "summarize-run": ("run",), "parse-papers": ("run",), "extract": ("run",),
        "build-graph": ("run", "out"), "detect-gaps": ("run",), "verify-gaps": ("run",), "report": ("run",), "audit-release": ("root",), "run-all": ("config", "run"),
    }.items():
        part = sub.add_parser(name)
        for w in wants:
            part.add_argument(w)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "validate-config":
        from lacuna import config

        found = config.problems(config.load(args.paths))
        print(json.dumps(found))
        return int(bool(found))
    if args.command == "list":
        from lacuna.plans import catalogue

        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.command == "run":
        from lacuna.plans import catalogue

        rows = catalogue.QUERIES[args.query](_session(), args.tables)
        rows.write.mode("overwrite").parquet(args.out) if args.out else rows.show(20, truncate=False)
        return 0
    from lacuna.plans import stages

    return stages.COMMANDS[args.command](args, _session)


if __name__ == "__main__":
    raise SystemExit(main())
