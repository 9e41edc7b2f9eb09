"""python -m parallaxis.cli inspect|decode|render|list PATH ...: the library's jobs from a shell. inspect exits with 1 if a check fails."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parallaxis", description=__doc__)
    sub = parser.add_subparsers(dest="job", required=True)
    for job in ("inspect", "list"):
        sub.add_parser(job).add_argument("path")
    decode = sub.add_parser("decode")
    decode.add_argument("path")
    decode.add_argument("out")
    decode.add_argument("--force", action="store_true")
    render = sub.add_parser("render")
    render.add_argument("path")
    render.add_argument("out")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"parallaxis {a.job}").getOrCreate()
    if a.job == "inspect":
        from parallaxis.checks import report

        t = report.tables(spark, a.path)
        for r in report.statistics(t).toLocalIterator():
            print(r.scan_id, {k: v for k, v in r.asDict().items() if v is not None and k != "scan_id"})
        failed = 0
        for r in report.checks(t).orderBy("scan_id", "check_no").toLocalIterator():
            failed += not r.passed
            print(f"{r.scan_id} [{'PASS' if r.passed else 'FAIL'}] {r.name}")
        t.release()
        return int(failed > 0)
    from parallaxis.sources import sinks

    if a.job == "decode":
        for r in sinks.decode(spark, a.path, a.out, a.force).toLocalIterator():
            print(f"{r.scan_id}: {r.frames} frames, {r.bytes} bytes")
    elif a.job == "render":
        for r in sinks.render(spark, a.path, a.out).groupBy("scan_id").count().toLocalIterator():
            print(f"{r.scan_id}: {r['count']} panels")
    else:
        for r in sinks.catalog(spark, a.path).select(F.to_json(F.struct("*")).alias("r")).toLocalIterator():
            print(r.r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
