"""Acquisition and cohort operators.

Cohort shape at scale. The reference joins every order back to its user's
first purchase. Here orders are first pre-aggregated to one row per
(user, order day) -- a map-side-combined hash aggregate, so a user holding a
third of all orders collapses to at most one row per calendar day -- and the
first purchase is a window ``min`` over that user's day rows: the group a
task sees is bounded by the number of distinct order days, not by the order
count. Every later step (LTV, retention, 90-day retention) is computed per
user in the same partitioning (no further exchange) and then rolled up per
cohort with a partial aggregate over a few hundred groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.contracts import DEFAULT_LTV_LOOKBACK_DAYS
from mktpulse.functions.dates import month_start, months_between_firsts
from mktpulse.functions.ratios import money, ratio


# ------------------------------------------------------------------ C1-C4
def first_order(orders: DataFrame) -> DataFrame:
    """First order timestamp and date per user (over the frame given)."""
    return (orders.groupBy("user_id").agg(F.min("order_ts").alias("first_order_ts"))
            .withColumn("first_order_dt", F.to_date("first_order_ts")))


def new_buyers_daily(orders: DataFrame, start=None, end=None) -> DataFrame:
    """Users whose first order falls on each day (optionally within a range)."""
    f = first_order(orders)
    if start is not None:
        f = f.filter(F.col("first_order_dt") >= F.to_date(F.lit(str(start))))
    if end is not None:
        f = f.filter(F.col("first_order_dt") <= F.to_date(F.lit(str(end))))
    return f.groupBy(F.col("first_order_dt").alias("dt")).agg(F.count("user_id").alias("new_buyers"))


def new_buyers_of(days: DataFrame, start=None, end=None) -> DataFrame:
    """C2 from ``user_days``: a user's row on the first day is the new buyer."""
    first = days.filter(F.col("order_dt") == F.col("first_purchase_dt"))
    if start is not None:
        first = first.filter(F.col("order_dt") >= F.to_date(F.lit(str(start))))
    if end is not None:
        first = first.filter(F.col("order_dt") <= F.to_date(F.lit(str(end))))
    return first.groupBy(F.col("order_dt").alias("dt")).agg(F.count("user_id").alias("new_buyers"))


def cac_daily(ads: DataFrame, orders_all: DataFrame, start, end, days: DataFrame | None = None) -> DataFrame:
    """``mart_cac_daily``. "New" means first order over *all* orders
    (D14); spend by day left-joined with new buyers; CAC NULL when none. ``days``: the ``user_days`` of all orders, if
    they are there already."""
    nb = new_buyers_daily(orders_all, start, end) if days is None else new_buyers_of(days, start, end)
    return _cac(ads, nb)


def cac_daily_range(ads: DataFrame, orders_filtered: DataFrame) -> DataFrame:
    """C4: as C3, but "first" is the first order within the filtered frame."""
    return _cac(ads, new_buyers_daily(orders_filtered))


def _cac(ads: DataFrame, nb: DataFrame) -> DataFrame:
    sp = ads.groupBy(F.to_date("dt").alias("dt")).agg(F.sum(money("spend")).alias("spend"))
    j = sp.join(nb, "dt", "left").select(
        "dt", F.col("spend").cast("double").alias("spend"),
        F.coalesce("new_buyers", F.lit(0)).cast("bigint").alias("new_buyers"))
    return j.withColumn("CAC", ratio("spend", "new_buyers", "null"))


# ------------------------------------------------------------------ cohorts
def user_days(orders: DataFrame) -> DataFrame:
    """Per (user, order day): exact revenue, plus the user's first order day
    and cohort month. NULL users never match a first purchase (inner-join
    semantics of the reference), so they are dropped here."""
    daily = (orders.filter(F.col("user_id").isNotNull())
             .groupBy("user_id", F.to_date("order_ts").alias("order_dt"))
             .agg(F.sum(money("revenue")).alias("revenue")))
    w = Window.partitionBy("user_id")
    first = F.min("order_dt").over(w)
    return daily.withColumns({"first_purchase_dt": first, "cohort_month": month_start(first)})


def ltv_by_cohort(orders: DataFrame, lookback_days: int = DEFAULT_LTV_LOOKBACK_DAYS,
                  on_zero: str = "null", days: DataFrame | None = None) -> DataFrame:
    """L1-L3: ``mart_ltv_cohort``: customers with revenue in the first
    ``lookback_days`` days after their first purchase, that revenue, and
    revenue per customer (revenue, not margin)."""
    if not 0 <= lookback_days:
        raise ValueError("lookback_days must be >= 0")
    ud = user_days(orders) if days is None else days
    since = F.datediff("order_dt", "first_purchase_dt")
    per_user = (ud.filter((since >= 0) & (since <= lookback_days))
                .groupBy("user_id", "cohort_month").agg(F.sum("revenue").alias("revenue")))
    c = (per_user.groupBy("cohort_month")
         .agg(F.count("user_id").alias("customers"), F.sum("revenue").cast("double").alias("revenue_lookback")))
    return c.withColumn("LTV_lookback", ratio("revenue_lookback", "customers", on_zero))


def retention_rates(orders: DataFrame, sort: bool = True, days: DataFrame | None = None) -> DataFrame:
    """``mart_retention_cohort``: distinct active users per
    (cohort month, order month), cohort size, rate, whole-month offset.

    The cohort size is the offset-0 activity (every user is active in their
    own cohort month), read with a window over the small per-cohort result
    instead of a second pass over users.
    """
    ud = (user_days(orders) if days is None else days).filter(F.col("cohort_month").isNotNull())
    act = (ud.select("user_id", "cohort_month", month_start("order_dt").alias("order_month")).distinct()
           .groupBy("cohort_month", "order_month").agg(F.count("user_id").alias("active_customers")))
    size = F.max(F.when(F.col("order_month") == F.col("cohort_month"), F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    r = (act.withColumn("cohort_size", size)
            .withColumns({"retention_rate": F.col("active_customers") / F.col("cohort_size"),
                          "months_since_cohort": months_between_firsts("order_month", "cohort_month")}))
    # the mart is presented in cohort order; callers that reshape it (the
    # matrix) skip the global sort
    return r.orderBy("cohort_month", "months_since_cohort") if sort else r


def retention_matrix(retention: DataFrame) -> DataFrame:
    """Cohort x month offset -> retention rate, absent cells 0.

    One column per offset present in the data (named by the offset); Spark
    finds the distinct offsets with a job of its own (bounded by the number
    of calendar months), then pivots the per-cohort rows. Pass a materialised
    retention table (``session.materialize_small``): both steps read it.
    """
    m = (retention.groupBy("cohort_month").pivot("months_since_cohort")
         .agg(F.first("retention_rate")))
    return m.fillna(0.0).orderBy("cohort_month")


def retention_cells(retention: DataFrame) -> DataFrame:
    """R4 in long form: every (cohort month, offset) from 0 to the largest offset of any cohort, rate 0 where
    the cohort has no active customers then.

    One pass: a cohort's rates become one map, the largest offset is a window over the cohorts (a row per
    calendar month), and the cells are unfolded from the row itself. No join, no second scan.
    """
    per_cohort = retention.groupBy("cohort_month").agg(
        F.map_from_entries(F.collect_list(F.struct("months_since_cohort", "retention_rate"))).alias("rates"),
        F.max("months_since_cohort").alias("last"))
    most = F.max("last").over(Window.partitionBy(F.lit(1)))
    cells = F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.struct(
        i.alias("months_since_cohort"), F.coalesce(F.try_element_at("rates", i), F.lit(0.0)).alias("retention_rate")))
    return per_cohort.withColumn("most", most).select("cohort_month", F.inline(cells))


def retention_90d(orders: DataFrame, days: int = 90) -> DataFrame:
    """Share of users with an order within ``days`` days of their first.

    As in the reference this is always 1.0 (the first order itself has offset
    0). ``repeat_rate`` is the useful variant: an order 1..``days`` days after
    the first (same pass, separate column)."""
    ud = user_days(orders)
    since = F.datediff("order_dt", "first_purchase_dt")
    per_user = ud.groupBy("user_id").agg(
        F.max(((since >= 0) & (since <= days)).cast("int")).alias("within"),
        F.max(((since >= 1) & (since <= days)).cast("int")).alias("repeat"))
    s = per_user.agg(F.count("user_id").alias("users"),
                     F.sum("within").cast("bigint").alias("retained_users"),
                     F.sum("repeat").cast("bigint").alias("repeat_users"))
    return s.withColumns({"retention_rate": ratio("retained_users", "users", "null"),
                          "repeat_rate": ratio("repeat_users", "users", "null")})


# ------------------------------------------------------------------ G1
def growth_summary(ltv: DataFrame, cac: DataFrame) -> DataFrame:
    """G1: unweighted mean cohort LTV (``LTV_horizon``; 0.0 without cohorts),
    mean daily CAC (NULLs skipped; NULL without any) and CLV = LTV - CAC.

    The CAC mean enters as a scalar subquery: one value, no join."""
    avg_cac = cac.agg(F.avg("CAC")).scalar()
    return (ltv.agg(F.coalesce(F.avg("LTV_horizon"), F.lit(0.0)).alias("avg_LTV"))
               .withColumn("avg_CAC", avg_cac)
               .withColumn("CLV", F.col("avg_LTV") - F.col("avg_CAC")))


def ltv_horizon(orders: DataFrame, horizon_days: int = 180) -> DataFrame:
    """L1-L3 with the growth dashboard's names and zero policy
    (``revenue_h``, ``LTV_horizon``, 0.0 when no customers)."""
    l = ltv_by_cohort(orders, horizon_days, on_zero="zero")
    return l.select("cohort_month", "customers", F.col("revenue_lookback").alias("revenue_h"),
                    F.col("LTV_lookback").alias("LTV_horizon"))
