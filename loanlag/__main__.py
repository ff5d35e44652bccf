"""Command-line jobs, one per analysis, for ``spark-submit`` or ``python -m``.

    python -m loanlag cohort    --input DIR --as-of TS --out DIR [--day created_day|dtpayment]
    python -m loanlag monthly   --input DIR --as-of TS --out DIR [--start 2014-09-01 --periods 6 --day ...]
    python -m loanlag factor    --input DIR --out DIR [--factor country --exclude developed]
    python -m loanlag behaviour --input DIR --out DIR [--positive repaid|good_behaviour]

``--input`` holds one folder (or file) per table: multi_payments, loans,
users, listings, credit_reports.  ``--jdbc-url`` reads the same tables from a
database instead (user and password from a properties file, never the command
line).  Every result is written as parquet under ``--out/<name>``; nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import presets
from .functions.values import parse_values
from .operators import by_late_pct, in_cohort_order, in_day_order
from .plans import behaviour_report, cohort_late_ratios, factor_report, monthly_report
from .session import cluster_conf, configure
from .sources import LoanTables, read_jdbc_table_split, read_tables
from .sources.schemas import SCHEMAS

GROUPS = {
    "developed": presets.DEVELOPED_COUNTRIES,
    "oct_spike": presets.OCT_SPIKE_GROUP,
    "default": presets.DEFAULT_GROUP,
}


def _values(text: str | None) -> list | None:
    """A named group, or a comma-separated list of values."""
    if text is None:
        return None
    if text in GROUPS:
        return list(GROUPS[text])
    return [v for v in text.split(",") if v]


def _read_properties(path: str) -> dict[str, str]:
    props = {}
    with open(path) as fh:
        for line in fh:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                props[key.strip()] = value.strip()
    return props


def load_tables(spark: SparkSession, args: argparse.Namespace) -> LoanTables:
    if args.jdbc_url:
        props = _read_properties(args.jdbc_properties) if args.jdbc_properties else {}
        creds = dict(user=props.get("user"), password=props.get("password"),
                     driver=props.get("driver"))
        parts = args.jdbc_partitions or 2 * spark.sparkContext.defaultParallelism
        return LoanTables(**{
            name: read_jdbc_table_split(spark, name, args.jdbc_url, parts, **creds)
            for name in SCHEMAS})
    options = dict(opt.split("=", 1) for opt in args.read_option)
    return read_tables(spark, {name: os.path.join(args.input, name) for name in SCHEMAS},
                       args.format, options)


def session_conf(args: argparse.Namespace) -> dict[str, str]:
    """``cluster_conf`` for the size and cores on the command line; nothing without them."""
    if (args.input_gb is None) != (args.cores is None):
        raise SystemExit("--input-gb and --cores go together")
    return cluster_conf(int(args.input_gb * 2**30), args.cores) if args.cores else {}


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(out, name))


def run(spark: SparkSession, argv: Sequence[str]) -> dict[str, DataFrame]:
    """Run one job; returns the written DataFrames by output name."""
    args = parser().parse_args(list(argv))
    if args.job in ("cohort", "monthly") and not args.as_of:
        raise SystemExit("--as-of is required for cohort and monthly jobs")
    if not args.input and not args.jdbc_url:
        raise SystemExit("give --input or --jdbc-url")
    if args.jdbc_partitions is not None and args.jdbc_partitions < 2:
        raise SystemExit("--jdbc-partitions must be at least 2: one connection would read a table in one task")
    configure(spark, session_conf(args))
    tables = load_tables(spark, args)
    listing_opts = dict(payment_types=None if args.all_payment_types else tuple(args.payment_types),
                        exclude_refinanced=not args.keep_refinanced,
                        exclude_refinancing=args.exclude_refinancing)
    if args.job == "cohort":
        series = cohort_late_ratios(tables, args.as_of, args.day, args.days,
                                    _values(args.group), not args.group_only,
                                    checkpoint=args.checkpoint, cache=not args.checkpoint,
                                    **listing_opts)
        out = {"total": in_day_order(series.total), "by_group": in_day_order(series.by_group)}
        shared = series.daily
    elif args.job == "monthly":
        out = {"monthly": in_cohort_order(monthly_report(tables, args.as_of, args.start,
                                                         args.periods, day=args.day, **listing_opts))}
        shared = None
    elif args.job == "factor":
        exclude = _values(args.exclude)
        if exclude is not None:
            exclude = parse_values(exclude, SCHEMAS["credit_reports"][args.factor].dataType)
        report = factor_report(tables.credit_reports, args.factor, exclude, cache=True)
        out, shared = {"payback": by_late_pct(report.table), "totals": report.totals}, report.grouped
    else:
        report = behaviour_report(tables.users, tables.credit_reports, args.positive, cache=True)
        out, shared = {"payback": by_late_pct(report.table), "totals": report.totals}, report.grouped
    for name, df in out.items():
        _write(df, args.out, name)
    if shared is not None:
        shared.unpersist()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m loanlag", description=__doc__.split("\n\n")[0])
    p.add_argument("job", choices=["cohort", "monthly", "factor", "behaviour"])
    p.add_argument("--input", help="folder with one sub-folder per table")
    p.add_argument("--format", default="parquet", help="file format of --input")
    p.add_argument("--read-option", action="append", default=[], metavar="KEY=VALUE",
                   help="reader option for --input, e.g. header=true (repeatable)")
    p.add_argument("--jdbc-url", help="read the tables over JDBC instead of --input")
    p.add_argument("--jdbc-properties", help="file with user=, password=, driver= lines")
    p.add_argument("--jdbc-partitions", type=int, default=None,
                   help="parallel range reads per table, split on its id column, 2 or more "
                        "(default: twice the session's cores)")
    p.add_argument("--input-gb", type=float, default=None,
                   help="size of the input; with --cores, sizes shuffles and broadcasts for it")
    p.add_argument("--cores", type=int, default=None, help="cores of the cluster")
    p.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    p.add_argument("--as-of", default=None, help="instant the payments are due by")
    p.add_argument("--day", default=presets.DEFAULT_DAY_KEY, choices=presets.DAY_KEYS)
    p.add_argument("--days", type=int, default=presets.DEFAULT_WINDOW_DAYS)
    p.add_argument("--group", default="default", help="group name or comma-separated values")
    p.add_argument("--group-only", action="store_true", help="leave out the rest-of-population series")
    p.add_argument("--checkpoint", action="store_true",
                   help="cut lineage of the shared daily table in spark.checkpoint.dir")
    p.add_argument("--start", default=presets.DEFAULT_MONTHLY_START)
    p.add_argument("--periods", type=int, default=presets.DEFAULT_MONTHLY_PERIODS)
    p.add_argument("--payment-types", type=int, nargs="+",
                   default=list(presets.THIRTY_DAY_PAYMENT_TYPES))
    p.add_argument("--all-payment-types", action="store_true")
    p.add_argument("--keep-refinanced", action="store_true")
    p.add_argument("--exclude-refinancing", action="store_true")
    p.add_argument("--factor", default="country", choices=presets.FACTORS)
    p.add_argument("--exclude", default=None, help="group name or comma-separated values")
    p.add_argument("--positive", default="repaid", choices=["repaid", "good_behaviour"])
    return p


def main(argv: Sequence[str] | None = None) -> None:
    import sys

    argv = list(sys.argv[1:] if argv is None else argv)
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"loanlag-{args.job}").getOrCreate()
    run(spark, argv)


if __name__ == "__main__":
    main()
