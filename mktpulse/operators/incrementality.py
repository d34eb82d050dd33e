"""Holdout incrementality.

Exposure-window join without pairs. The reference left-joins every exposure
row with every order of the same (user, campaign) and keeps the pairs whose
order lies 0..lookback days after the exposure. Here both sides are first
pre-aggregated per day -- exposures to (user, campaign, group, day) with a
multiplicity, orders to (user, campaign, day) with revenue and count -- and
the window sum is a RANGE frame ``[day, day + lookback]`` over the union of
the two, partitioned by (user, campaign). Work per group is bounded by the
number of distinct days (a hot user/campaign collapses to one row per day
before the shuffle), and the result equals the pair join row for row,
including its quirks (D11: exposures whose orders all fall outside the window
leave the denominator; D13: duplicate exposures count their revenue again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.contracts import DEFAULT_EXPOSURE_LOOKBACK_DAYS, TEST_SHARE
from mktpulse.functions.hashing import md5_fraction
from mktpulse.functions.ratios import MONEY, MONEY_SUM, money, ratio


def exposed_users(exposure: DataFrame, orders: DataFrame,
                  lookback_days: int = DEFAULT_EXPOSURE_LOOKBACK_DAYS, keep_all_exposed: bool = False) -> DataFrame:
    """I1 + I2: one row per (user, campaign, group) that survives the window
    filter, with ``converted`` (0/1) and exact in-window ``revenue``.

    ``keep_all_exposed=True`` keeps users whose only orders lie outside the
    window in the denominator, as not converted (the window as a join condition, D11)."""
    if lookback_days < 0:
        raise ValueError("lookback_days must be >= 0")
    exp = (exposure.select("user_id", "campaign", F.lower("group").alias("group"),
                           F.to_date("exposure_ts").alias("day"))
           .groupBy("user_id", "campaign", "group", "day").agg(F.count(F.lit(1)).alias("m")))
    od = (orders.groupBy("user_id", "campaign", F.to_date("order_ts").alias("day"))
          .agg(F.sum(money("revenue")).alias("rev"), F.count(F.lit(1)).alias("n")))
    rows = (exp.select("user_id", "campaign", "group", "day", "m",
                       F.lit(None).cast(MONEY_SUM).alias("rev"), F.lit(None).cast("bigint").alias("n"))
            .unionByName(od.select("user_id", "campaign", F.lit(None).cast("string").alias("group"), "day",
                                   F.lit(None).cast("bigint").alias("m"), "rev", "n")))
    rows = rows.withColumn("d", F.unix_date("day"))
    # one partitioning and one ordering for all four sums (one sort, one
    # Window operator); only the frames differ
    ordered = Window.partitionBy("user_id", "campaign").orderBy("d")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = ordered.rangeBetween(0, lookback_days)
    dated = F.col("day").isNotNull()
    rows = rows.withColumns({
        "n_total": F.sum("n").over(whole),
        "n_undated": F.sum(F.when(~dated, F.col("n"))).over(whole),
        "n_win": F.sum(F.when(dated, F.col("n"))).over(ahead),
        "rev_win": F.sum(F.when(dated, F.col("rev"))).over(ahead)})
    # Exposure rows only. A NULL key or NULL exposure day never matches an order.
    keyed = F.col("user_id").isNotNull() & F.col("campaign").isNotNull()
    n_total = F.when(keyed, F.coalesce("n_total", F.lit(0))).otherwise(F.lit(0))
    n_undated = F.when(keyed, F.coalesce("n_undated", F.lit(0))).otherwise(F.lit(0))
    n_win = F.when(keyed & F.col("day").isNotNull(), F.coalesce("n_win", F.lit(0))).otherwise(F.lit(0))
    rev_win = F.when(keyed & F.col("day").isNotNull(), F.col("rev_win"))
    e = (rows.filter(F.col("m").isNotNull())
         .select("user_id", "campaign", "group", "m",
                 n_total.alias("n_total"), n_undated.alias("n_undated"), n_win.alias("n_win"),
                 rev_win.alias("rev_win")))
    if not keep_all_exposed:
        e = e.filter((F.col("n_total") == 0) | (F.col("n_undated") > 0) | (F.col("n_win") > 0))
    return (e.groupBy("user_id", "campaign", "group")
            .agg(F.max((F.col("n_win") > 0).cast("int")).alias("converted"),
                 # repeated exposures count their orders again; the factor is small, so the product keeps its places
                 F.coalesce(F.sum((F.col("rev_win").cast(MONEY) * F.col("m").cast("decimal(9,0)")).cast(MONEY)),
                            F.lit(0).cast(MONEY_SUM)).alias("revenue")))


def duplicate_exposures(exposure: DataFrame) -> DataFrame:
    """(user, campaign) with several exposures, whose in-window revenue counts once per exposure:
    user_id, campaign, exposures, groups (more than one: exposed in both arms)."""
    return (exposure.groupBy("user_id", "campaign")
            .agg(F.count(F.lit(1)).alias("exposures"), F.countDistinct(F.lower("group")).alias("groups"))
            .filter("exposures > 1"))


def arm_rollup(users: DataFrame) -> DataFrame:
    """Users, converters, revenue, cvr, rpu by campaign and group."""
    c = (users.groupBy("campaign", "group")
         .agg(F.count("user_id").alias("users"), F.sum("converted").cast("bigint").alias("converters"),
              F.sum("revenue").alias("revenue")))
    return c.withColumns({"revenue": F.col("revenue").cast("double"),
                          "cvr": ratio("converters", "users"),
                          "rpu": ratio("revenue", "users")})


def incrementality_uplift(exposure: DataFrame, orders: DataFrame,
                          lookback_days: int = DEFAULT_EXPOSURE_LOOKBACK_DAYS, keep_all_exposed: bool = False) -> DataFrame:
    """``mart_incrementality_uplift``: test vs control per campaign,
    absolute CVR and revenue-per-user uplift, scaled by test users. A
    campaign lacking either arm is dropped (D12). One conditional aggregate
    over the arm rows replaces the test/control self-join."""
    arms = arm_rollup(exposed_users(exposure, orders, lookback_days, keep_all_exposed))
    t, c = F.col("group") == "test", F.col("group") == "control"
    w = (arms.groupBy("campaign").agg(
        F.max(F.when(t, F.col("users"))).alias("users_test"),
        F.max(F.when(t, F.col("cvr"))).alias("cvr_test"),
        F.max(F.when(t, F.col("rpu"))).alias("rpu_test"),
        F.max(F.when(c, F.col("users"))).alias("users_control"),
        F.max(F.when(c, F.col("cvr"))).alias("cvr_control"),
        F.max(F.when(c, F.col("rpu"))).alias("rpu_control"),
        F.count(F.when(t, 1)).alias("_t"), F.count(F.when(c, 1)).alias("_c"))
        .filter((F.col("_t") > 0) & (F.col("_c") > 0)).drop("_t", "_c"))
    dc = F.col("cvr_test") - F.col("cvr_control")
    dr = F.col("rpu_test") - F.col("rpu_control")
    return w.withColumns({"uplift_cvr_abs": dc, "uplift_rpu_abs": dr,
                          "incremental_converters": dc * F.col("users_test"),
                          "incremental_revenue": dr * F.col("users_test")})


# ------------------------------------------------------------------ I5-I7
def order_arm(orders: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Reproducible Test/Control label per order from md5(order_id)."""
    return orders.withColumn("holdout_group", F.when(md5_fraction("order_id") < test_share, F.lit("Test"))
                             .otherwise(F.lit("Control")))


def ads_arm(ads: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Ads keep their own ``holdout_group``; without the column each row gets
    an md5 label of its (dt, channel, campaign) key."""
    if "holdout_group" in ads.columns:
        return ads
    key = F.concat_ws("|", F.col("dt").cast("string"), "channel", "campaign")
    return ads.withColumn("holdout_group", F.when(md5_fraction(key) < test_share, F.lit("Test"))
                          .otherwise(F.lit("Control")))


def holdout_detail(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """Spend and revenue by holdout group (full outer combination, missing
    side 0), ROAS 0.0 without spend. A union + one aggregate stands in for the
    full outer join of two per-group rollups."""
    sp = ads_arm(ads).select("holdout_group", money("spend").alias("spend"),
                             F.lit(None).cast(MONEY).alias("revenue"))
    rv = order_arm(orders).select("holdout_group", F.lit(None).cast(MONEY).alias("spend"),
                                  money("revenue").alias("revenue"))
    g = (sp.unionByName(rv).groupBy("holdout_group")
         .agg(F.coalesce(F.sum("spend"), F.lit(0)).cast("double").alias("spend"),
              F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("revenue")))
    return g.withColumn("ROAS", ratio("revenue", "spend", "zero")).orderBy(F.asc_nulls_first("holdout_group"))


def holdout_summary(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """metric/value rows: Test revenue, Control revenue, and the lift
    (test - control) / control (NULL when control revenue is not > 0)."""
    d = holdout_detail(ads, orders)
    s = d.agg(F.sum(F.when(F.col("holdout_group") == "Test", F.col("revenue")).otherwise(0.0)).alias("t"),
              F.sum(F.when(F.col("holdout_group") == "Control", F.col("revenue")).otherwise(0.0)).alias("c"))
    s = s.select(F.col("t").alias("Test revenue"), F.col("c").alias("Control revenue"),
                 F.when(F.col("c") > 0, (F.col("t") - F.col("c")) / F.col("c")).alias("Incremental lift"))
    return s.unpivot([], ["Test revenue", "Control revenue", "Incremental lift"], "metric", "value")
