"""Land sheets, publish the tables, write the results: ``python -m tillroll A=a.csv B=b.csv --out DIR``.

Exits with 2 when a build assertion, a test of nulls, keys or references, or freshness fails (a warning
does not). All results are written first, so a failing run can be looked into.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date, datetime, timezone
from functools import partial

from pyspark.sql import SparkSession

from tillroll.plans import history
from tillroll.plans.warehouse import analysis, checks, monitors, publish_catalog, publish_files
from tillroll.sources.sheets import land, read_csv_sheet, read_parquet_sheet
from tillroll.sources.sinks import write_metrics


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tillroll", description=__doc__.splitlines()[0])
    parser.add_argument("sheets", nargs="+", metavar="NAME=PATH", help="source sheets: files or folders")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv", help="format of the sheets")
    parser.add_argument("--out", required=True, help="folder for the tables and the analysis")
    parser.add_argument("--database", help="save the tables in this catalog database instead of --out")
    parser.add_argument("--staging-view", action="store_true", help="keep staging a view (with --database)")
    parser.add_argument("--start-date", type=date.fromisoformat, required=True, help="best-seller period start")
    parser.add_argument("--campaign-day", type=date.fromisoformat, help="report what a campaign of this day brought")
    parser.add_argument("--lapsed-country", help="report the lapsed big spenders of this country")
    parser.add_argument("--load", help="name of this load in the history; the time it began if not given")
    parser.add_argument("--history", help="folder of the load history (default: history below --out)")
    parser.add_argument("--multiline", action="store_true", help="CSV fields may hold line breaks")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tillroll").getOrCreate()
    csv = partial(read_csv_sheet, multiline=args.multiline)
    read = csv if args.format == "csv" else read_parquet_sheet
    sheets = [read(spark, path, name) for name, path in (sheet.split("=", 1) for sheet in args.sheets)]
    now = datetime.now(timezone.utc)
    raw = land(sheets, now)

    if args.database:
        tables = publish_catalog(raw, args.database, args.staging_view)
    else:
        tables = publish_files(raw, args.out)

    load, kept = args.load or now.isoformat(), args.history or f"{args.out}/history"
    past = history.record_load(tables["raw"], sheets, load, kept)
    results = analysis(tables, args.start_date, args.campaign_day, args.lapsed_country)
    write_metrics(results | monitors(tables) | past, f"{args.out}/analysis")
    required = checks(tables, now)
    write_metrics(required, f"{args.out}/checks")
    failed = []
    for name in required:
        written = spark.read.json(f"{args.out}/checks/{name}")
        if not written.filter("NOT passed").isEmpty():
            failed.append(name)
            written.filter("NOT passed").show(truncate=False)
    print(f"checks: {', '.join(failed)} failed" if failed else "checks: all passed")
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
