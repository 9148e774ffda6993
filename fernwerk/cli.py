"""Command line: ``python -m fernwerk.cli run|<stage>|areas|query``. A run reads the tables of --data and writes layers and exports to --out."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from fernwerk.sources.profiles import STAGES, Config, areas, chosen


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernwerk")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run stages, in their own order")
    run.add_argument("--only")
    run.add_argument("--skip")
    stages = [run, *(sub.add_parser(s, help=f"run {s} alone") for s in STAGES)]
    for one in stages:
        one.add_argument("--config", default="config")
        one.add_argument("--data", default="data")
        one.add_argument("--out", default="output")
        one.add_argument("--aoi")
        one.add_argument("--species")
        one.add_argument("--reuse-imagery", action="store_true", help="score again from stored indices")
    a = sub.add_parser("areas", help="list the areas")
    a.add_argument("--config", default="config")
    q = sub.add_parser("query", help="show a registered query")
    q.add_argument("name")
    q.add_argument("data")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "areas":
        print("\n".join(areas(Path(args.config) / "aoi")))
        return 0
    if args.command == "query":
        from pyspark.sql import SparkSession

        from fernwerk.plans.catalog import QUERIES

        QUERIES[args.name](SparkSession.builder.getOrCreate(), args.data).show(truncate=False)
        return 0
    from pyspark.sql import SparkSession

    from fernwerk.plans.build import Build

    stages = chosen(args.only, args.skip) if args.command == "run" else [args.command]
    cfg = Config.load(args.config, aoi=args.aoi, species=args.species)
    build = Build(SparkSession.builder.getOrCreate(), cfg, args.data, args.out)
    for s in stages:
        began = time.perf_counter()
        done = build.run([s], args.reuse_imagery)
        print(f"[{s}] " + ("done" if done else "not part of this profile") + f" ({time.perf_counter() - began:.1f} s)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
