"""Paid media performance.

Shapes that matter at scale:

* every rollup is a hash aggregate with a map-side partial step, so a hot
  ``(dt, channel, campaign)`` key is combined before the shuffle;
* the two exact distinct counts of the purchase rollup are planned by Catalyst
  as one Expand + two-level aggregate (shuffled on the distinct value too, so a
  hot group is still spread);
* the ads and purchase rollups are both hash-partitioned on the join keys, so
  the left join that follows adds no exchange of its own;
* money is summed exactly as decimal and cast to double once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.functions.ratios import MONEY_SUM, money, ratio

KEYS = ["dt", "channel", "campaign"]


def _to_double(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ P1 / P2
def paid_rollup(ads: DataFrame) -> DataFrame:
    """Impressions, clicks, spend by dt, channel, campaign (spend exact)."""
    return (ads.groupBy(F.to_date("dt").alias("dt"), "channel", "campaign")
            .agg(F.sum(F.col("impressions").cast("bigint")).alias("impressions"),
                 F.sum(F.col("clicks").cast("bigint")).alias("clicks"),
                 F.sum(money("spend")).alias("spend")))


def media_ratios(df: DataFrame, on_zero: str = "null") -> DataFrame:
    """CTR, CPC, CPM; denominators <= 0 follow ``on_zero``."""
    return df.withColumns({
        "CTR": ratio("clicks", "impressions", on_zero),
        "CPC": ratio("spend", "clicks", on_zero),
        "CPM": ratio(F.col("spend").cast("double") * 1000.0, "impressions", on_zero)})


# ------------------------------------------------------------------ P3 / P4
def purchase_rollup(orders: DataFrame) -> DataFrame:
    """Distinct orders, revenue, margin, distinct buyers by dt, channel, campaign."""
    return (orders.groupBy(F.to_date("order_ts").alias("dt"), "channel", "campaign")
            .agg(F.countDistinct("order_id").alias("orders"),
                 F.sum(money("revenue")).alias("revenue"),
                 F.sum(money("revenue") - money("cost")).alias("margin"),
                 F.countDistinct("user_id").alias("buyers")))


def paid_perf_daily(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """The ``mart_paid_perf_daily`` mart (main dashboard semantics).

    Left join from ads: orders on days without spend are not reported (D16).
    Ratios are NULL on a zero denominator (D1); MER equals ROAS (D17).
    """
    paid = media_ratios(paid_rollup(ads))
    buy = purchase_rollup(orders)
    j = paid.join(buy, KEYS, "left").withColumns({
        "orders": F.coalesce("orders", F.lit(0)).cast("bigint"),
        "buyers": F.coalesce("buyers", F.lit(0)).cast("bigint"),
        "revenue": F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)),
        "margin": F.coalesce(F.col("margin").cast("double"), F.lit(0.0)),
        "spend": F.col("spend").cast("double")})
    return j.select(
        *KEYS, "impressions", "clicks", "spend", "CTR", "CPC", "CPM", "orders", "revenue", "margin", "buyers",
        ratio("orders", "clicks").alias("CVR_click_to_order"),
        ratio("revenue", "spend").alias("ROAS"),
        ratio("margin", "spend").alias("GM_ROAS"),
        ratio("revenue", "spend").alias("MER"),
        ratio("revenue", "orders").alias("AOV"),
    )


# ------------------------------------------------------------------ P5
def paid_daily_exact(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """P5 before the ratios, money still decimal: the shared input of P6, P7,
    P9 and P13 (persist it when several of them run in one job). A sum over
    nothing but NULLs is 0, on the ads side too (D5)."""
    a = paid_rollup(ads)
    o = (orders.groupBy(F.to_date("order_ts").alias("dt"), "channel", "campaign")
         .agg(F.countDistinct("order_id").alias("orders"),
              F.countDistinct("user_id").alias("buyers"),
              F.sum(money("revenue")).alias("revenue"),
              F.sum(money("cost")).alias("cost")))
    zero = F.lit(0)
    return (a.join(o, KEYS, "left")
            .select(*KEYS, F.coalesce("impressions", zero).cast("bigint").alias("impressions"),
                    F.coalesce("clicks", zero).cast("bigint").alias("clicks"),
                    F.coalesce("spend", zero.cast(MONEY_SUM)).alias("spend"),
                    F.coalesce("orders", zero).cast("bigint").alias("orders"),
                    F.coalesce("buyers", zero).cast("bigint").alias("buyers"),
                    F.coalesce("revenue", zero.cast(MONEY_SUM)).alias("revenue"),
                    F.coalesce("cost", zero.cast(MONEY_SUM)).alias("cost")))


def _zero_ratios(df: DataFrame, **extra) -> DataFrame:
    return df.withColumns({
        "CTR": ratio("clicks", "impressions", "zero"),
        "CVR": ratio("orders", "clicks", "zero"),
        "ROAS": ratio("revenue", "spend", "zero"), **extra})


def paid_daily(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """P5: daily paid table of the growth dashboard, ratios 0.0 on a zero
    denominator, GM_ROAS = (revenue - cost) / spend."""
    d = _zero_ratios(paid_daily_exact(ads, orders),
                     GM_ROAS=ratio((F.col("revenue") - F.col("cost")).cast("double"), "spend", "zero"),
                     AOV=ratio("revenue", "orders", "zero"))
    return _to_double(d, {"spend", "revenue", "cost"})


def daily_trend(paid_exact: DataFrame) -> DataFrame:
    """P5 rolled up by dt; ROAS, CTR, CVR of the sums."""
    d = (paid_exact.groupBy("dt")
         .agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
              F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
              F.sum("orders").alias("orders")))
    return _to_double(_zero_ratios(d), {"spend", "revenue"})


def _rollup_with_cac(paid_exact: DataFrame, keys: list[str]) -> DataFrame:
    d = (paid_exact.groupBy(*keys)
         .agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
              F.sum("orders").alias("orders"), F.sum("buyers").alias("buyers"),
              F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")))
    d = _zero_ratios(d, CAC=ratio("spend", "buyers", "null"))
    return _to_double(d, {"spend", "revenue"})


def campaign_table(paid_exact: DataFrame) -> DataFrame:
    """By channel, campaign. ``buyers`` are buyer-days (D18); CAC NULL when 0."""
    return _rollup_with_cac(paid_exact, ["channel", "campaign"])


def top_campaigns(paid_exact: DataFrame, n: int = 10) -> DataFrame:
    """The N best campaigns by revenue (ties: channel, campaign). Top-k
    runs as TakeOrderedAndProject: each task keeps N rows, the driver merges."""
    return top_of(campaign_table(paid_exact), n)


def top_of(campaigns: DataFrame, n: int = 10) -> DataFrame:
    """P8 over a campaign table that is there already."""
    if not 1 <= n:
        raise ValueError("n must be positive")
    return campaigns.orderBy(F.desc("revenue"), F.asc_nulls_last("channel"), F.asc_nulls_last("campaign")).limit(n)


def channel_summary(paid_exact: DataFrame) -> DataFrame:
    """By channel; ROAS, CAC, CTR, CVR."""
    return _rollup_with_cac(paid_exact, ["channel"])


def kpi_cards(paid_exact: DataFrame) -> DataFrame:
    """One-row totals; ratios of sums, 0.0 on a zero denominator."""
    s = paid_exact.agg(
        F.sum("spend").alias("total_spend"), F.sum("revenue").alias("total_revenue"),
        F.sum("orders").alias("total_orders"), F.sum("buyers").alias("total_buyers"),
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    zero = F.lit(0)
    s = s.select(
        F.coalesce(F.col("total_spend").cast("double"), F.lit(0.0)).alias("total_spend"),
        F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce("total_orders", zero).cast("bigint").alias("total_orders"),
        F.coalesce("total_buyers", zero).cast("bigint").alias("total_buyers"),
        F.coalesce("clicks", zero).alias("clicks"), F.coalesce("impressions", zero).alias("impressions"))
    return s.select(
        "total_spend", "total_revenue", "total_orders", "total_buyers",
        ratio("total_revenue", "total_spend", "zero").alias("ROAS"),
        ratio("clicks", "impressions", "zero").alias("CTR"),
        ratio("total_orders", "clicks", "zero").alias("CVR"),
        ratio("total_revenue", "total_orders", "zero").alias("AOV"),
    )


# ------------------------------------------------------------------ P6, P7, P9, P13 in one pass
#: Levels of the lattice by grouping id: a bit for each of dt, channel, campaign that is summed over.
LEVELS = {0b011: "day", 0b100: "campaign", 0b101: "channel", 0b111: "total"}


def paid_lattice(paid_exact: DataFrame) -> DataFrame:
    """P6, P7, P9 and P13 as one GROUPING SETS aggregate over P5: a row for every day, (channel, campaign), channel
    and the total, told apart by ``level`` (a NULL key of the data is not a key that was summed over).

    Each row of P5 is expanded to four and combined map-side; the scans and the distinct counts of P5 run once. Without
    any row there is no total either; ``lattice_view`` gives the zeros of P13 then.
    """
    names = ["spend", "revenue", "orders", "buyers", "impressions", "clicks"]
    g = (paid_exact.groupingSets([["dt"], ["channel", "campaign"], ["channel"], []], "dt", "channel", "campaign")
         .agg(F.grouping_id().alias("_id"), *[F.sum(c).alias(c) for c in names]))
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("_id").cast("int")]
    g = _zero_ratios(g, CAC=ratio("spend", "buyers", "null"), AOV=ratio("revenue", "orders", "zero"), level=level)
    return _to_double(g.select("level", *KEYS, *names, "CTR", "CVR", "ROAS", "CAC", "AOV"), {"spend", "revenue"})


def lattice_view(lattice: DataFrame, level: str) -> DataFrame:
    """One of ``daily_trend``, ``campaign_table``, ``channel_summary`` or ``kpi_cards`` from a lattice: the rows of a level."""
    rows = lattice.where(F.col("level") == level)
    sums = ["spend", "revenue", "orders", "buyers", "impressions", "clicks"]
    if level == "day":
        return rows.select("dt", "spend", "revenue", "clicks", "impressions", "orders", "CTR", "CVR", "ROAS")
    if level in ("campaign", "channel"):
        keys = ["channel", "campaign"] if level == "campaign" else ["channel"]
        return rows.select(*keys, *sums, "CTR", "CVR", "ROAS", "CAC")
    if level != "total":
        raise ValueError(f"unknown level {level!r}")
    zero = F.lit(0.0)
    one = rows.agg(*[F.coalesce(F.max(c), zero).alias(c) for c in ("spend", "revenue", "ROAS", "CTR", "CVR", "AOV")],
                   *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in ("orders", "buyers")])
    return one.select(*[F.col(c).alias(f"total_{c}") for c in ("spend", "revenue", "orders", "buyers")], "ROAS", "CTR", "CVR", "AOV")


# ------------------------------------------------------------------ P10 / P14 / T1
def channel_kpi(ads: DataFrame, orders: DataFrame) -> DataFrame:
    """P10 + B1: per-channel KPIs of the channel script, unguarded ratios
    (zero denominators give NULL instead of inf/NaN, D3). Orders are counted
    with count(order_id), customers distinct (D19). LTV = AOV x 3."""
    a = (ads.groupBy("channel")
         .agg(F.sum(F.col("impressions").cast("bigint")).alias("impressions"),
              F.sum(F.col("clicks").cast("bigint")).alias("clicks"),
              F.sum(money("spend")).alias("spend")))
    o = (orders.groupBy("channel")
         .agg(F.count("order_id").alias("orders"), F.sum(money("revenue")).alias("revenue"),
              F.countDistinct("user_id").alias("customers")))
    k = (a.join(o, "channel", "left")
         .select("channel", "impressions", "clicks", F.col("spend").cast("double").alias("spend"),
                 F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
                 F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
                 F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers")))
    aov = ratio("revenue", "orders", "unguarded")
    cac = ratio("spend", "customers", "unguarded")
    return k.withColumns({
        "CTR": ratio("clicks", "impressions", "unguarded"),
        "CVR": ratio("orders", "clicks", "unguarded"),
        "CAC": cac,
        "ROAS": ratio("revenue", "spend", "unguarded"),
        "AOV": aov,
        "LTV": aov * 3.0,
        "CLV": aov * 3.0 - cac})


def kpi_cards_channel(channel_kpis: DataFrame) -> DataFrame:
    """Totals, overall ROAS, and the unweighted mean of channel CAC."""
    s = channel_kpis.agg(F.sum(money("spend")).alias("total_spend"),
                         F.sum(money("revenue")).alias("total_revenue"),
                         F.avg("CAC").alias("avg_CAC"))
    return s.select(F.col("total_spend").cast("double").alias("total_spend"),
                    F.col("total_revenue").cast("double").alias("total_revenue"),
                    ratio("total_revenue", "total_spend", "unguarded").alias("ROAS"),
                    "avg_CAC")


# ------------------------------------------------------------------ P11 / P12 / P15
def campaign_kpis(campaign_daily: DataFrame) -> DataFrame:
    """Row-wise KPIs of the pre-aggregated campaign file (unguarded)."""
    return campaign_daily.withColumns({
        "CTR": ratio("clicks", "impressions", "unguarded"),
        "CVR": ratio("orders", "clicks", "unguarded"),
        "ROAS": ratio("revenue", "spend", "unguarded"),
        "GM_ROAS": ratio(F.col("revenue").cast("double") - F.col("cost").cast("double"), "spend", "unguarded"),
        "AOV": ratio("revenue", "orders", "unguarded")})


def campaign_ranking(campaign_daily: DataFrame) -> DataFrame:
    """P11 sorted by ROAS, best first, NULL ROAS last."""
    return campaign_kpis(campaign_daily).orderBy(F.desc_nulls_last("ROAS"), "dt", "campaign")


def campaign_cards(campaign_daily: DataFrame) -> DataFrame:
    """Total spend, revenue, orders and overall ROAS of the campaign file."""
    s = campaign_daily.agg(F.sum(money("spend")).alias("total_spend"),
                           F.sum(money("revenue")).alias("total_revenue"),
                           F.sum(F.col("orders").cast("bigint")).alias("total_orders"))
    return s.select(F.col("total_spend").cast("double").alias("total_spend"),
                    F.col("total_revenue").cast("double").alias("total_revenue"),
                    "total_orders",
                    ratio("total_revenue", "total_spend", "unguarded").alias("ROAS"))
