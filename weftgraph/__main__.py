"""Command line: ``python -m weftgraph --store DIR COMMAND ...``; answers are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from weftgraph.api import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    top.add_argument("--store", required=True)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: object) -> None:
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        for o, default in options.items():
            kind = type(default) if default is not None else str
            sub.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if default is False else {"type": kind, "default": default}))

    add("create", "workspace")
    add("workspaces")
    add("artifacts", "workspace")
    add("ingest", "path", workspace="default", lens=None, provenance="primary")
    add("status", "workspace")
    add("search", "workspace", "query", k=8)
    add("edges", "workspace", "name", min_confidence=0.0)
    add("connections", "workspace", kind=None, min_confidence=0.0, cross_repo_only=False)
    add("candidates", "workspace", kind=None, limit=25)
    add("neighbors", "workspace", "name", relation=None, limit=50)
    return top


def run(engine: Engine, args: argparse.Namespace) -> object:
    a = vars(args)
    calls = {
        "create": lambda: engine.create_workspace(a["workspace"]),
        "workspaces": engine.list_workspaces,
        "artifacts": lambda: engine.list_artifacts(a["workspace"]),
        "ingest": lambda: engine.ingest(a["path"], a["workspace"], a["lens"], a["provenance"]),
        "status": lambda: engine.overview(a["workspace"]),
        "search": lambda: engine.search(a["workspace"], a["query"], a["k"]),
        "edges": lambda: engine.cross_edges(a["workspace"], a["name"], a["min_confidence"]),
        "connections": lambda: engine.connections(a["workspace"], a["kind"], a["min_confidence"], a["cross_repo_only"]),
        "candidates": lambda: engine.binding_candidates(a["workspace"], a["kind"], a["limit"]),
        "neighbors": lambda: engine.neighbors(a["workspace"], a["name"], a["relation"], None, a["limit"]),
    }
    return calls[a["command"]]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    answer = run(Engine(spark, args.store), args)
    if isinstance(answer, DataFrame):
        for line in answer.toJSON().toLocalIterator():
            print(line)
    else:
        print(json.dumps(answer, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
