"""Command line: ``spark-submit`` this package, or ``python -m merchantlens``.

    load       merchants.csv transactions.csv WAREHOUSE
    append     transactions.csv WAREHOUSE
    check      WAREHOUSE
    explore    WAREHOUSE --out DIR
    watch      WAREHOUSE --out DIR
    forecast   WAREHOUSE [--level Platform|Category|Merchant] [--horizon N] [--baseline | --by-error] [--scaled]
    dashboard  WAREHOUSE --start DAY --end DAY [--category C] [--merchant M] --out DIR
    ask        WAREHOUSE --start DAY --end DAY QUESTION...

Every job takes --out DIR: tables then go to CSV folders under it.  Without it they are
printed whole, and a table longer than a screen (200 rows) stops the job.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, types as T

from merchantlens.functions import rules
from merchantlens.functions.dates import Period
from merchantlens.operators.filters import Filters
from merchantlens.plans import dashboard, explore, forecasting, load, selections, watch
from merchantlens.sources import readers, writers
from merchantlens.sources.local import constant_table

SCREEN = 200
QUESTION = T.StructType([T.StructField("text", T.StringType())])


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="merchantlens")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *positional: str, selection: bool = False):
        sub = jobs.add_parser(name)
        for argument in positional:
            sub.add_argument(argument)
        sub.add_argument("--out")
        if selection:
            sub.add_argument("--start", required=True)
            sub.add_argument("--end", required=True)
            sub.add_argument("--category")
            sub.add_argument("--merchant")
            sub.add_argument("--horizon", type=int, default=rules.HORIZON)
        return sub

    job("load", "merchants", "transactions", "warehouse")
    job("append", "transactions", "warehouse")
    job("check", "warehouse")
    job("explore", "warehouse")
    job("watch", "warehouse")
    forecast = job("forecast", "warehouse")
    forecast.add_argument("--level", default="Platform")
    forecast.add_argument("--horizon", type=int, default=rules.HORIZON)
    forecast.add_argument("--trees", type=int, default=100)
    forecast.add_argument("--baseline", action="store_true")
    forecast.add_argument("--by-error", action="store_true")
    forecast.add_argument("--scaled", action="store_true")
    job("dashboard", "warehouse", selection=True)
    job("ask", "warehouse", selection=True).add_argument("questions", nargs="+")
    return parser.parse_args(argv)


def deliver(tables: dict[str, DataFrame], out: str | None) -> None:
    for name, df in tables.items():
        if out:
            writers.write_csv(df, f"{out.rstrip('/')}/{name}")
        else:
            rows = df.limit(SCREEN + 1).count()
            if rows > SCREEN:
                raise SystemExit(f"{name} has more than {SCREEN} rows: name a folder with --out")
            print(name)
            df.show(SCREEN, truncate=False)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "load":
        counts = load.load(spark, args.merchants, args.transactions, args.warehouse)
        deliver({"row_counts": counts}, args.out)
        return
    if args.job == "append":
        deliver({"row_counts": load.append(spark, args.transactions, args.warehouse)}, args.out)
        return
    house = load.Warehouse(args.warehouse)
    if args.job == "check":
        deliver(load.check(spark, args.warehouse), args.out)
        return
    if args.job == "forecast":
        stored = forecasting.forecast(
            spark,
            args.warehouse,
            args.level,
            args.horizon,
            use_trees=not args.baseline,
            by_error=args.by_error,
            scaled=args.scaled,
            trees=args.trees,
        )
        deliver({"forecasts": stored.orderBy("series_key", "target_date")}, args.out)
        return
    names = ("daily_aggregates", "transactions", "merchants")
    daily, txns, merchants = (house.table(spark, name) for name in names)
    if args.job == "explore":
        deliver(explore.explore(daily, txns, merchants), args.out)
        return
    if args.job == "watch":
        deliver(watch.watch(daily, txns, merchants), args.out)
        return
    chosen = Filters(Period.of(args.start, args.end), args.category, args.merchant)
    if args.job == "ask":
        asked = constant_table(spark, [(q,) for q in args.questions], QUESTION)
        answered = selections.ask(spark, args.warehouse, asked, chosen, args.horizon)
        deliver({"answers": answered}, args.out)
        return
    forecasts = readers.if_present(lambda: house.table(spark, "forecasts"))
    importance = readers.if_present(
        lambda: readers.read_importance(spark, house.importance_path())
    )
    deliver(
        dashboard.dashboard(
            daily, txns, merchants, chosen, forecasts, importance, args.horizon
        ),
        args.out,
    )


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("merchantlens").getOrCreate()
    run(spark, arguments(argv))


if __name__ == "__main__":
    main()
