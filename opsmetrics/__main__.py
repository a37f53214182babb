"""Command line: run the dashboard views or the upload step as Spark jobs.

    python -m opsmetrics dashboard --operations PATH --out DIR [--years 2024 ...]
        [--months 2024-01 ...] [--tipos A M ...] [--owners X ...] [--views a,b] [--csv] [--day-first]
    python -m opsmetrics usage --sessions PATH --out DIR [--loads PATH] [--as-of DATE] [--days 30] [--csv]
    python -m opsmetrics upload --upload FILE --stored PATH --out DIR [--store] [--append] [--day-first] [--serials]

Each view or report is written by the executors under DIR/<name>.
"""

from __future__ import annotations

import argparse
import datetime as dt

from opsmetrics.operators import ingest
from opsmetrics.plans.dashboard import dashboard, loads, usage
from opsmetrics.session import build_session
from opsmetrics.sources import (
    OperationsStore,
    append_load_log,
    append_operations,
    export_csv,
    read_load_log,
    read_operations,
    read_sessions,
    read_upload,
)


def _write(df, path: str, csv: bool) -> None:
    if csv:
        export_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def run_dashboard(spark, args) -> list[str]:
    ops = read_operations(spark, args.operations, fmt=args.format, day_first=args.day_first)
    views = dashboard(
        ops,
        years=[int(y) for y in args.years] if args.years is not None else None,
        months=args.months,
        tipos=args.tipos,
        operativos=args.owners,
        persist=True,
    )
    names = args.views.split(",") if args.views else list(views)
    for name in names:
        _write(views[name], f"{args.out.rstrip('/')}/{name}", args.csv)
    views.release()
    return names


def run_usage(spark, args) -> list[str]:
    stored = read_sessions(spark, args.sessions, fmt=args.format)
    views = usage(stored, dt.datetime.fromisoformat(args.as_of) if args.as_of else dt.datetime.now(), args.days)
    if args.loads:
        views |= loads(read_load_log(spark, args.loads, fmt=args.format))
    for name, view in views.items():
        _write(view, f"{args.out.rstrip('/')}/{name}", args.csv)
    return list(views)


def run_upload(spark, args) -> dict[str, int]:
    raw = read_upload(spark, args.upload, fmt=args.upload_format)
    # every stored row counts as existing, also those without fecha_file
    stored = OperationsStore(spark, args.stored) if args.store else spark.read.format(args.format).load(args.stored)
    result = ingest.analyze_upload(raw, stored, checkpoint=True, day_first=args.day_first, serials=args.serials, sort_duplicates=True)
    out = args.out.rstrip("/")
    export_csv(result.duplicates, f"{out}/duplicados", single_file=False)
    export_csv(result.quality, f"{out}/calidad", single_file=True)
    counts = result.counts.first().asDict()
    counts["fechas_ilegibles"] = {r["campo"]: r["fechas_ilegibles"] for r in result.bad_dates.collect()}
    if args.append:
        written = stored.append(result.new) if args.store else append_operations(result.new, args.stored, fmt=args.format)
        append_load_log(result.summary, f"{out}/cargas_log")
        counts["insertados"] = written
    return counts


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="opsmetrics")
    sub = parser.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dashboard")
    d.add_argument("--operations", required=True)
    d.add_argument("--format", default="parquet")
    d.add_argument("--out", required=True)
    d.add_argument("--years", nargs="*")
    d.add_argument("--months", nargs="*")
    d.add_argument("--tipos", nargs="*")
    d.add_argument("--owners", nargs="*")
    d.add_argument("--views")
    d.add_argument("--csv", action="store_true")
    d.add_argument("--day-first", action="store_true")
    s = sub.add_parser("usage")
    s.add_argument("--sessions", required=True)
    s.add_argument("--loads")
    s.add_argument("--format", default="parquet")
    s.add_argument("--out", required=True)
    s.add_argument("--as-of")
    s.add_argument("--days", type=int, default=30)
    s.add_argument("--csv", action="store_true")
    u = sub.add_parser("upload")
    u.add_argument("--upload", required=True)
    u.add_argument("--upload-format", default="csv")
    u.add_argument("--stored", required=True)
    u.add_argument("--format", default="parquet")
    u.add_argument("--out", required=True)
    u.add_argument("--store", action="store_true", help="--stored is a store of committed loads with a key index")
    u.add_argument("--append", action="store_true")
    u.add_argument("--day-first", action="store_true")
    u.add_argument("--serials", action="store_true", help="five-digit numbers in date columns are days since 1899-12-30")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "dashboard":
        print(",".join(run_dashboard(spark, args)))
    elif args.command == "usage":
        print(",".join(run_usage(spark, args)))
    else:
        print(run_upload(spark, args))


if __name__ == "__main__":
    main()
