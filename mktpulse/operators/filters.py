"""Filters, parameter queries and derived columns.

All are narrow transformations; the date predicates are written on
``to_date(ts)`` so Catalyst rewrites them into parquet-pushable comparisons on
the raw timestamp column.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(x) -> Column:
    if isinstance(x, Column):
        return F.to_date(x)
    if isinstance(x, (_dt.date, _dt.datetime)):
        x = x.isoformat()[:10]
    return F.to_date(F.lit(str(x)))


def date_range(df: DataFrame, ts_col: str, start, end, add_dt: str | None = "dt") -> DataFrame:
    """keep rows whose ``to_date(ts)`` lies in [start, end], both ends inclusive."""
    d = F.to_date(F.col(ts_col))
    out = df.filter((d >= _date(start)) & (d <= _date(end)))
    return out.withColumn(add_dt, d) if add_dt else out


def membership(df: DataFrame, channels=None, campaigns=None) -> DataFrame:
    """channel / campaign IN-lists; ``None`` means no restriction."""
    if channels is not None:
        df = df.filter(F.col("channel").isin(list(channels)))
    if campaigns is not None:
        df = df.filter(F.col("campaign").isin(list(campaigns)))
    return df


def apply_dashboard_filters(ads: DataFrame, orders: DataFrame, web: DataFrame, start, end,
                            channels=None, campaigns=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F1 + F2 as the growth dashboard applies them: date range on all three
    tables, channel and campaign on ads and orders, campaign only on web."""
    a = membership(date_range(ads, "dt", start, end, add_dt=None), channels, campaigns)
    o = membership(date_range(orders, "order_ts", start, end, add_dt=None), channels, campaigns)
    w = membership(date_range(web, "event_ts", start, end, add_dt=None), None, campaigns)
    return a, o, w


def filter_options(ads: DataFrame, orders: DataFrame, web: DataFrame) -> DataFrame:
    """sorted distinct option lists, long form ``(kind, value)``.

    channels over ads and orders; campaigns over ads, orders and web events.
    Each table is scanned once; one distinct, combined map-side, serves both lists.
    """
    def kinds(df, *cols):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in cols]))
                         .alias("o")).select("o.kind", "o.value")

    return (kinds(ads, "channel", "campaign").union(kinds(orders, "channel", "campaign")).union(kinds(web, "campaign"))
            .distinct().orderBy("kind", F.asc_nulls_last("value")))


def date_bounds(ads: DataFrame, orders: DataFrame, web: DataFrame) -> DataFrame:
    """overall min and max date across the three tables (one row)."""
    dates = (ads.select(F.to_date("dt").alias("d"))
             .union(orders.select(F.to_date("order_ts").alias("d")))
             .union(web.select(F.to_date("event_ts").alias("d"))))
    return dates.agg(F.min("d").alias("min_dt"), F.max("d").alias("max_dt"))
