"""Runs a definition over a table: python -m loomgraph definition.json --rows orders.parquet --column price=o_totalprice

Inputs are JSON values, or texts where they are none. Without rows there is one execution. Statuses and outputs are
printed, or, with --out, written as Parquet; the exit code is 1 if an execution has failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.compile import KEY, Compiler
from loomgraph.plans.runner import bounded
from loomgraph.plans.spec import Definitions, InvalidDefinition, load


def value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def pairs(given: list[str]) -> dict[str, str]:
    for x in given:
        if "=" not in x:
            raise SystemExit(f"{x!r} is not name=value")
    return dict(x.split("=", 1) for x in given)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("definition", help="a JSON file")
    p.add_argument("--input", action="append", default=[], metavar="NAME=VALUE", help="an input, the same for all executions")
    p.add_argument("--rows", help="a Parquet table with a row for each execution")
    p.add_argument("--key", default=KEY, help="the column of rows that names executions")
    p.add_argument("--column", action="append", default=[], metavar="NAME=COLUMN", help="an input that is a column of rows")
    p.add_argument("--with", dest="known", action="append", default=[], metavar="FILE", help="a definition that steps may run as a child")
    p.add_argument("--out", help="where to write executions as Parquet")
    p.add_argument("--check", action="store_true", help="validate and compile only")
    p.add_argument("--timeout", type=float, default=0.0, help="seconds, 0 for none")
    p.add_argument("--master", help="a Spark master, if spark-submit doesn't name one")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    try:
        d = load(a.definition)
        known = Definitions()
        for path in a.known:
            known.register(load(path))
    except (InvalidDefinition, OSError, ValueError) as e:
        print(f"invalid definition: {e}", file=sys.stderr)
        return 2
    for w in d.warnings():
        print(f"warning: {w}", file=sys.stderr)
    builder = SparkSession.builder.appName(f"loomgraph {d.name}")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    rows = spark.read.parquet(a.rows).withColumn(KEY, F.col(a.key)) if a.rows else spark.range(1).select(F.col("id").alias(KEY))
    try:
        compiled = Compiler(d, definitions=known).compile(rows, {k: value(v) for k, v in pairs(a.input).items()}, pairs(a.column))
    except ValueError as e:
        print(f"{d.name}: {e}", file=sys.stderr)
        return 2
    if a.check:
        return 0
    done = compiled.executions

    def run() -> int:
        if a.out:
            done.write.mode("overwrite").parquet(a.out)
            return spark.read.parquet(a.out).where("status = 'failed'").limit(1).count()
        done.show(20, truncate=False)
        return done.where("status = 'failed'").limit(1).count()

    return 1 if bounded(spark, a.timeout, run) else 0


if __name__ == "__main__":
    sys.exit(main())
