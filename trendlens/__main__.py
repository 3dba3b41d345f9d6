"""Command line: the console tool's queries, non-interactively.

    python -m trendlens top    PATH [--n 10] [--level1 X] [--level2 Y] [--from D] [--to D] [--exclude-totals]
    python -m trendlens info   PATH
    python -m trendlens values PATH COLUMN [--search TERM] [--page 0] [--page-size 50]
    python -m trendlens export PATH OUT --values A B ... [--column category] [--format csv|parquet]
    python -m trendlens download PATH FOLDER [--level1 X] [--level2 Y] [--from D] [--to D] [--single-file]

PATH is a CSV or Parquet file or folder (type by suffix, else CSV).  Under
spark-submit the cluster's session is used.  Only bounded results are shown:
the top-N, one page of values, one row of dataset info.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from trendlens.operators import aggregate as agg
from trendlens.operators import topn
from trendlens.plans import trending
from trendlens.plans.export import export_categories, export_filtered
from trendlens.plans.roles import detect_roles
from trendlens.sources.readers import read_table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m trendlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    top = sub.add_parser("top", help="top topics by the metric")
    top.add_argument("path")
    top.add_argument("--n", type=int, default=trending.TOP_N)
    top.add_argument("--exclude-totals", action="store_true")
    down = sub.add_parser("download", help="filtered rows as CSV, under a name made of the categories")
    down.add_argument("path")
    down.add_argument("folder")
    for p_ in (top, down):
        p_.add_argument("--level1")
        p_.add_argument("--level2")
        p_.add_argument("--from", dest="start")
        p_.add_argument("--to", dest="end")
    down.add_argument("--single-file", action="store_true")
    info = sub.add_parser("info", help="rows, distinct topics and categories, date range")
    info.add_argument("path")
    vals = sub.add_parser("values", help="sorted distinct values of a column, one page")
    vals.add_argument("path")
    vals.add_argument("column")
    vals.add_argument("--search")
    vals.add_argument("--page", type=int, default=0)
    vals.add_argument("--page-size", type=int, default=50)
    exp = sub.add_parser("export", help="rows of some categories to CSV or Parquet")
    exp.add_argument("path")
    exp.add_argument("out")
    exp.add_argument("--values", nargs="+", required=True)
    exp.add_argument("--column", default="category")
    exp.add_argument("--format", choices=("csv", "parquet"), default="csv")
    return p


def _range(start, end):
    """Inclusive, open at an end that is not given."""
    return (start, end) if start or end else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trendlens").getOrCreate()
    if args.cmd == "export":
        n = export_categories(spark, args.path, args.values, args.out, fmt=args.format, column=args.column)
        print(f"{n:,} rows written to {args.out}")
        return 0
    df = read_table(spark, args.path)
    roles = detect_roles(df.columns)
    if args.cmd == "download":
        out, n = export_filtered(df, args.folder, args.level1, args.level2, _range(args.start, args.end), roles, args.single_file)
        print(f"{n:,} rows written to {out}")
    elif args.cmd == "top":
        out = trending.top_topics(
            df, args.n, args.level1, args.level2, _range(args.start, args.end), args.exclude_totals, roles
        )
        out.show(args.n, truncate=False)
        print(trending.caption(args.level1, args.level2, _range(args.start, args.end)).strip())
    elif args.cmd == "info":
        agg.dataset_info(df, roles.topic, roles.level1, roles.level2, roles.date).show(truncate=False)
    elif args.cmd == "values":
        values = (
            trending.level_search(df, args.column, args.search)
            if args.search
            else agg.distinct_values(df, args.column)
        )
        topn.page(values, [args.column], args.page_size, args.page).show(args.page_size, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
