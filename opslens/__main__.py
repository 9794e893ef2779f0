"""Command line: run the whole health check for one snapshot directory.

    python -m opslens --landed /shared/landed --as-of "2024-01-31 00:00:00" --out /shared/reports

``--landed`` names the folder of the landed tables (``sources/landing.py``);
``--snapshot`` runs on tables derived from a star-schema test directory.

The Spark master and all cluster settings come from ``spark-submit`` / the
environment; this only builds the reports and writes them. The day becomes
visible as a whole, by a commit at the end (``sources/commits.py``).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from opslens import report
from opslens.session import RECOMMENDED_CONF, size_shuffles
from opslens.sources.fixtures import Snapshot
from opslens.sources.landing import LandedSnapshot


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="opslens", description=__doc__.splitlines()[0])
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--landed", help="folder with the landed tables")
    source.add_argument("--snapshot", help="directory with star-schema test tables")
    ap.add_argument("--as-of", required=True, help="report time, 'YYYY-MM-DD HH:MM:SS' (no zone)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--threshold", type=float, default=90.0, help="capacity alert threshold, percent")
    ap.add_argument("--parallel-jobs", type=int, default=4, help="report writes submitted at once")
    ap.add_argument("--plain", action="store_true", help="overwrite the day's folders table by table, without a commit")
    args = ap.parse_args(argv)
    builder = SparkSession.builder.appName("opslens-health-check")
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    size_shuffles(spark, args.landed or args.snapshot)
    tables = LandedSnapshot(spark, args.landed, args.as_of) if args.landed else Snapshot(spark, args.snapshot)
    paths = report.run(tables, args.as_of, args.out,
                       parallel_jobs=args.parallel_jobs, staged=not args.plain, threshold=args.threshold)
    print(json.dumps(paths, indent=1))


if __name__ == "__main__":
    main()
