"""Funnel operators.

Distinct session counts are exact. The pivoted funnel counts distinct
sessions per (campaign, event) first -- a two-level aggregate shuffled on the
session id, so a hot campaign is spread -- and only then pivots the tiny result
(one row per campaign and stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.contracts import FUNNEL_STAGES, STAGE_LABELS
from mktpulse.functions.ratios import ratio

# Display labels of the four stages, in funnel order, and of the
# coarse three-stage funnel.
STAGE_TITLES = ["Page view", "Product view", "Add to cart", "Begin checkout"]
COARSE_STAGES = ["Impressions", "Clicks", "Orders"]


def stage_map():
    """U1 lookup: event name -> funnel stage label."""
    return F.create_map(*[F.lit(x) for pair in zip(FUNNEL_STAGES, STAGE_LABELS) for x in pair])


def with_stage(web: DataFrame) -> DataFrame:
    """Map the event name to its stage and drop every other event."""
    return (web.withColumn("funnel_stage", F.try_element_at(stage_map(), F.col("event_name")))
               .filter(F.col("funnel_stage").isNotNull()))


def funnel_stage_daily(web: DataFrame) -> DataFrame:
    """``mart_funnel_stage_daily``: distinct sessions by dt, source, medium,
    campaign and stage. NULL keys form their own group (D4)."""
    return (with_stage(web)
            .groupBy(F.to_date("event_ts").alias("dt"), "source", "medium", "campaign", "funnel_stage")
            .agg(F.countDistinct("session_id").alias("sessions")))


def funnel_by_campaign(web: DataFrame) -> DataFrame:
    """U3 + U4: distinct sessions per campaign for each of the four events
    (0 when absent) and the three step rates (0.0 on a zero denominator)."""
    per = (web.filter(F.col("event_name").isin(FUNNEL_STAGES))
           .groupBy("campaign", "event_name")
           .agg(F.countDistinct("session_id").alias("n")))
    wide = per.groupBy("campaign").pivot("event_name", FUNNEL_STAGES).agg(F.first("n"))
    wide = wide.select("campaign", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in FUNNEL_STAGES])
    pv, prod, cart, chk = FUNNEL_STAGES
    return wide.withColumns({"pdp_rate": ratio(prod, pv, "zero"),
                             "atc_rate": ratio(cart, prod, "zero"),
                             "checkout_rate": ratio(chk, cart, "zero")})


def funnel_table(web: DataFrame) -> DataFrame:
    """U3 + U4 for display: rates rounded to 4 places half-to-even (as
    pandas does), largest page_view first."""
    f = funnel_by_campaign(web)
    f = f.withColumns({c: F.bround(c, 4) for c in ("pdp_rate", "atc_rate", "checkout_rate")})
    return f.orderBy(F.desc(FUNNEL_STAGES[0]), F.asc_nulls_last("campaign"))


def funnel_long(web: DataFrame, campaign: str | None = None) -> DataFrame:
    """One campaign's four counts as (stage, count) rows.

    ``campaign=None`` picks the first campaign in sorted order, as the
    dashboard's selector does by default; the pick is a scalar subquery,
    never a driver round trip.
    """
    return funnel_long_of(funnel_by_campaign(web), campaign)


def funnel_long_of(f: DataFrame, campaign: str | None = None) -> DataFrame:
    """U5 over an already computed ``funnel_by_campaign`` frame (pass a
    materialised one: the default pick reads it twice)."""
    if campaign is None:
        f = f.filter(F.col("campaign") == f.agg(F.min("campaign")).scalar())
    else:
        f = f.filter(F.col("campaign") == campaign)
    f = f.select("campaign", *[F.col(s).alias(t) for s, t in zip(FUNNEL_STAGES, STAGE_TITLES)])
    return f.unpivot("campaign", STAGE_TITLES, "stage", "count")


def funnel_coarse(channel_kpis: DataFrame) -> DataFrame:
    """Impressions, Clicks, Orders totals of the channel KPI table as rows."""
    s = channel_kpis.agg(*[F.sum(c.lower()).cast("bigint").alias(c) for c in COARSE_STAGES])
    return s.unpivot([], COARSE_STAGES, "stage", "count")
