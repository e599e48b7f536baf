"""python -m millrace prepare|status|describe|snapshot|inspect SPEC.json ROOT [SOURCE]

Ends with 0 if all is well, 1 if something is not ready, 2 if the specification is wrong.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from millrace.plans import build, spec
from millrace.ship import ship


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("action", choices=["prepare", "status", "describe", "snapshot", "inspect"])
    parser.add_argument("spec")
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("source", nargs="?")
    said = parser.parse_args(args)
    try:
        with open(said.spec) as f:
            data = build.dataset(json.load(f))
        if wrong := data.problems():
            raise ValueError("\n".join(wrong))
    except (OSError, ValueError, TypeError) as e:
        print(e, file=sys.stderr)
        return 2
    if said.action == "describe":
        print(spec.describe(data))
        return 0
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    ship(spark)
    try:
        if said.action == "prepare":
            for name, what in build.prepare(spark, data, said.root).items():
                print(name, what)
        elif said.action == "snapshot":
            print(build.snapshot(spark, data, said.root))
        elif said.action == "inspect":
            build.inspected(spark, data, said.source or next(iter(data.sources)), f"{said.root}/inspection")
        else:
            rows = build.status(spark, data, said.root)
            print(build.markdown(["source", "state", "reason", "rows"], rows))
            return 0 if all(state == "current" for _, state, *_ in rows) else 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
