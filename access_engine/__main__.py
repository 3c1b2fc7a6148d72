"""Command line of the three runs, for spark-submit or ``python -m access_engine``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from access_engine import jobs


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="access_engine", description=__doc__)
    runs = parser.add_subparsers(dest="run", required=True)
    options = {
        "classify": ["rasters", "population", "units", "grid", "out"],
        "catchments": ["layer", "population", "units", "grid", "out"],
        "statistics": ["results", "lookup", "out"],
    }
    for name, wanted in options.items():
        run = runs.add_parser(name)
        for option in wanted:
            run.add_argument(f"--{option}", required=True)
        if name == "classify":
            run.add_argument("--level", choices=["adm1", "adm2"], default="adm2")
        if name != "statistics":
            run.add_argument("--layout", choices=["cells", "segments"], default="cells")
            run.add_argument("--population-grid")
            run.add_argument("--update", action="store_true", help="compute only what changed since the run in --out")
    chosen = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("access-engine").getOrCreate()
    getattr(jobs, chosen.pop("run"))(spark, **chosen)


if __name__ == "__main__":
    main()
