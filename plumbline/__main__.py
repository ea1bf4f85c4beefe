"""Command line: check, gate, brief and report over a working tree; the exit code is 0 only if all is well."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from . import tools
from .workspace import scan


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    parser.add_argument("verb", choices=["check", "gate", "brief", "report"])
    parser.add_argument("path")
    parser.add_argument("--baseline", help="folder of the gate's baseline")
    parser.add_argument("--save", action="store_true", help="save the baseline instead of comparing with it")
    parser.add_argument("--limit", type=int, default=3)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    w = scan(spark, a.path)
    if a.verb == "check":
        found = tools.dispatch("check", w)
        verdict = rows(found["verdict"])[0]
        print(json.dumps({"verdict": verdict, "violations": rows(found["violations"])}, indent=1))
        return 0 if verdict["passed"] else 1
    if a.verb == "gate":
        found = tools.dispatch("gate", w, path=a.baseline or f"{a.path}/.plumbline/baseline", save=a.save)
        decision = rows(found["gate"])[0]
        print(json.dumps({"gate": decision, "diff": rows(found["diff"])[0]}, indent=1))
        return 1 if decision["degraded"] else 0
    if a.verb == "brief":
        print(json.dumps({k: rows(v) for k, v in tools.dispatch("agent_brief", w, limit=a.limit).items()}, indent=1))
        return 0
    print(json.dumps({"scan": rows(tools.dispatch("scan", w)["scan"]), "health": rows(tools.dispatch("health", w)["raw"]), "test_gaps": rows(tools.dispatch("test_gaps", w)["report"])}, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
