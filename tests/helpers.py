"""What test files share; fixtures are in conftest.py, which no file imports."""

import datetime as dt


def rows(df, *order):
    """Collected rows as tuples, sorted by ``order`` or by their text."""
    found = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return found if order else sorted(found, key=str)


def day(text):
    return dt.date.fromisoformat(text)


def series_of(spark, values, start="2024-01-01", key="s"):
    first = day(start)
    data = [
        (key, first + dt.timedelta(days=i), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, "series_key string, agg_date date, net_revenue double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
