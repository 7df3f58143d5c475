"""Runs the analysis over a folder of tables: python -m freshet DATA OUT [--phases a,b] [--cores n]

Each phase writes its table to OUT; a phase whose table stands already is skipped, one that fails does not stop the others.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.operators import stations
from freshet.plans import learners, measurement, reports
from freshet.session import build_session
from freshet.sources import files


def phases(spark: SparkSession, data: str, out: str) -> dict[str, Callable[[], str]]:
    """Name and call of every phase, in order."""
    tables: dict[str, Callable[[], DataFrame]] = {
        "master": lambda: reports.master(spark, data),
        "trends": lambda: measurement.trends(spark, data, True),
        "projection": lambda: stations.trend_projection(spark.read.parquet(f"{out}/trends")),
        "policies": lambda: stations.management_scenarios(spark.read.parquet(f"{out}/trends").filter("ion = 'cl'")),
        "scenarios": lambda: learners.scenario_projection(spark, data),
        "drivers": lambda: learners.QUERIES["level_drivers"](spark, data),
        "regimes": lambda: learners.QUERIES["regimes"](spark, data),
    }
    todo = {name: (lambda name=name, make=make: files.run_unit(spark, f"{out}/{name}", make)) for name, make in tables.items()}

    def summary() -> DataFrame:
        parts = {n: reports.QUERIES[n](spark, data) for n in ("pipeline_report", "base_outcomes", "trend_table", "guideline_table")}
        return files.summary_document(parts)

    return todo | {"summary": lambda: files.run_unit(spark, f"{out}/summary", summary)}


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="freshet")
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--phases", default="", help="names parted by commas; all where left out")
    p.add_argument("--cores", type=int, default=None, help="for a local run")
    a = p.parse_args(args)
    spark = build_session("freshet", a.cores)
    done = files.run_phases(phases(spark, a.data, a.out), tuple(x for x in a.phases.split(",") if x) or None)
    for name, outcome, message in done:
        print(f"{name}: {outcome} {message}".rstrip())
    return int(any(outcome == "failed" for _, outcome, _ in done))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
