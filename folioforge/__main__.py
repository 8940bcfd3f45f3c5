"""Command line: python -m folioforge FOLDER COMMAND ..., answers as JSON lines."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from folioforge.api import Engine, EngineError
from folioforge.operators.filters import EQUAL, Filters
from folioforge.plans.config import read_settings, write_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    p.add_argument("folder", help="folder of the tables")
    p.add_argument("--settings", type=Path, help="YAML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a settings file with the defaults")
    for name in ("health", "sources", "faults", "backfill"):
        sub.add_parser(name)
    for name in ("source", "chunk", "job"):
        sub.add_parser(name).add_argument("id")
    sub.add_parser("chunks").add_argument("--source")
    for name in ("search", "context"):
        s = sub.add_parser(name)
        s.add_argument("question")
        s.add_argument("--top-k", type=int)
        s.add_argument("--alpha", type=float)
        s.add_argument("--method", choices=("relative", "rrf"), default="relative")
        s.add_argument("--tag", action="append", default=[])
        s.add_argument("--page-start", type=int)
        s.add_argument("--page-end", type=int)
        for field in EQUAL:
            s.add_argument(f"--{field.replace('_', '-')}")
    return p


def answer(engine: Engine, a: argparse.Namespace):
    if a.command in ("search", "context"):
        f = Filters(equal={k: v for k in EQUAL if (v := getattr(a, k)) is not None}, tags=tuple(a.tag), page_start=a.page_start, page_end=a.page_end)
        return getattr(engine, a.command)(a.question, filters=f, top_k=a.top_k, alpha=a.alpha, method=a.method)
    if a.command in ("source", "chunk", "job"):
        return getattr(engine, a.command)(a.id)
    return {"health": engine.health, "sources": engine.sources, "faults": engine.index_faults, "backfill": engine.backfill, "chunks": lambda: engine.chunks(a.source)}[a.command]()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "init":
        write_settings(a.settings or Path(a.folder, "settings.yaml"))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for line in answer(Engine(spark, a.folder, read_settings(a.settings)), a).toJSON().toLocalIterator():
            print(line)
    except EngineError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
