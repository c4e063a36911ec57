"""``python -m corvine index|serve|search``: projects from --project and a TOML file."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from corvine.plans.indexer import specs
from corvine.plans.service import Engine
from corvine.streaming.watch import TreeWatcher


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    """S11."""
    p = argparse.ArgumentParser(prog="corvine", description=__doc__)
    p.add_argument("command", choices=["index", "serve", "search"])
    p.add_argument("text", nargs="?", default="", help="what to search for")
    p.add_argument("--project", action="append", default=[], help="root of a project; may be repeated")
    p.add_argument("--data-dir", default="", help="where a single project's tables lie")
    p.add_argument("--config", default="", help="TOML file with [[project]] tables (default: .corvine.toml here)")
    p.add_argument("--reindex", action="store_true", help="index from scratch")
    p.add_argument("--watch", action="store_true", help="serve: index again when files change")
    p.add_argument("--limit", type=int, default=10)
    return p.parse_args(args)


def main(args: list[str] | None = None, source=sys.stdin, sink=sys.stdout, spark: SparkSession | None = None) -> int:
    a = arguments(args)
    if a.config and not os.path.isfile(a.config):
        print(f"no file {a.config}", file=sys.stderr)
    projects = specs(a.project, a.data_dir, a.config or ".corvine.toml")
    if not projects:
        print("no projects: nothing is indexed", file=sys.stderr)
    own = spark is None
    spark = spark or SparkSession.builder.appName("corvine").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine, watchers = Engine(spark, projects), []
    try:
        done = engine.index(a.reindex)
        for root, counts in done.items():
            print(root, json.dumps(counts), file=sys.stderr)
        if a.command == "index":
            print(json.dumps(done), file=sink)
        elif a.command == "search":
            print(json.dumps(engine.search_code({"query": a.text, "limit": a.limit}), default=str), file=sink)
        else:
            if a.watch:
                watchers = [TreeWatcher(spark, p.root, lambda changes: engine.index()) for p in projects]
                for w in watchers:
                    w.start()
            engine.server().serve(source, sink)
    finally:
        for w in watchers:
            w.stop()
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
