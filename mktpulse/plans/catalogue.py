"""Registered queries: one per operator family of the survey's inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame (lazy, but for the few
that materialise a small aggregated table first, see PLANS.md) over the
whole test tables (no id subsets, no row caps; a limit appears only where it
is the feature, e.g. top-N). Column names equal those of ``plans/oracle.py``.
Binding A (tables derived from ``events``) unless the name says cohort (B).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktpulse.operators import attribution, budget, distinct, filters, funnel, growth, incrementality, paid, validate
from mktpulse.session import ensure_utc, materialize_small
from mktpulse.sources.bindings import Binding, raw_tables
from mktpulse.sources.readers import register_views
from mktpulse.sources.table_functions import register_functions

# The binding-A data covers January 2024; the dashboards' date filter is kept
# in every query (it is pushed into the parquet scan) with bounds that span it.
START, END = "2024-01-01", "2024-01-31"
# F2 example selection: three of the four channels, two of the three campaigns.
SEL_CHANNELS = ["Meta", "Google", "Email"]
SEL_CAMPAIGNS = ["Winter_Sale", "New_Arrivals"]
# Float aggregates over several rows (means, sums of ratios) are rounded to
# this many places so that summation order cannot show in the last bit.
FLOAT_PLACES = 6


_BINDINGS: dict = {}


def _binding(spark, sf_dir) -> Binding:
    """One Binding per (session, directory), reused by every query."""
    ensure_utc(spark)
    key = (id(spark), sf_dir)
    hit = _BINDINGS.get(key)
    if hit is None or hit.spark is not spark:
        hit = _BINDINGS[key] = Binding(spark, sf_dir)
    return hit


class _Filtered:
    """F1 on the three fact tables, as both dashboards apply it; each frame
    is built on first use and kept with the binding."""

    def __init__(self, spark, sf_dir, b: Binding | None = None):
        self.b = b or _binding(spark, sf_dir)

    @property
    def ads(self):
        return self.b._get("f_ads", lambda: filters.date_range(self.b.ads(), "dt", START, END, add_dt=None))

    @property
    def od(self):
        return self.b._get("f_od", lambda: filters.date_range(self.b.orders(), "order_ts", START, END,
                                                             add_dt=None))

    @property
    def web(self):
        return self.b._get("f_web", lambda: filters.date_range(self.b.web(), "event_ts", START, END,
                                                              add_dt=None))


def _filtered(spark, sf_dir, b: Binding | None = None) -> _Filtered:
    return _Filtered(spark, sf_dir, b)


def _exact(spark, sf_dir):
    """P5 before ratios (lazy; shared by P6, P7, P8, P9, P13 and B2)."""
    f = _filtered(spark, sf_dir)
    return f.b._get("paid_exact", lambda: paid.paid_daily_exact(f.ads, f.od))


def _channel_kpis(spark, sf_dir, materialize: bool = False):
    """P10 per channel. Materialised when B1 divides by its ROAS total (a
    scalar subquery would otherwise re-derive the table)."""
    f = _filtered(spark, sf_dir)
    k = paid.channel_kpi(f.ads, f.od)
    return materialize_small(k) if materialize else k


# ------------------------------------------------------------------ paid
def q_paid_perf_daily(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return paid.paid_perf_daily(f.ads, f.od)


def q_paid_daily_zero(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return paid.paid_daily(f.ads, f.od)


def q_daily_trend(spark, sf_dir):
    return paid.daily_trend(_exact(spark, sf_dir))


def q_campaign_table(spark, sf_dir):
    return paid.campaign_table(_exact(spark, sf_dir))


def q_top_campaigns(spark, sf_dir):
    return paid.top_campaigns(_exact(spark, sf_dir), 10)


def q_channel_summary(spark, sf_dir):
    return paid.channel_summary(_exact(spark, sf_dir))


def q_kpi_cards(spark, sf_dir):
    return paid.kpi_cards(_exact(spark, sf_dir))


def q_paid_lattice(spark, sf_dir):
    """P6, P7, P9 and P13 from one GROUPING SETS aggregate."""
    return paid.paid_lattice(_exact(spark, sf_dir))


def q_buyers_distinct(spark, sf_dir):
    """P3's buyers over the whole range, exact, from day bitmaps; beside it the buyer-days of D18."""
    return distinct.buyers_by_campaign(_filtered(spark, sf_dir).od)


def q_sessions_distinct(spark, sf_dir):
    """U2/U3's sessions per stage over the whole range, exact, from day bitmaps."""
    return distinct.sessions_by_stage(_filtered(spark, sf_dir).web)


def q_channel_kpi(spark, sf_dir):
    """P10 + B1 + T1: the channel KPI table with budget weight, rounded to 2."""
    return budget.round_numeric(budget.budget_weight(_channel_kpis(spark, sf_dir, materialize=True)), 2)


def q_kpi_cards_channel(spark, sf_dir):
    k = paid.kpi_cards_channel(_channel_kpis(spark, sf_dir))
    return k.withColumn("avg_CAC", F.round("avg_CAC", FLOAT_PLACES))


def q_campaign_kpis(spark, sf_dir):
    return paid.campaign_ranking(_binding(spark, sf_dir).campaign_daily())


def q_campaign_cards(spark, sf_dir):
    return paid.campaign_cards(_binding(spark, sf_dir).campaign_daily())


# ------------------------------------------------------------------ funnel
def q_funnel_stage_daily(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return funnel.funnel_stage_daily(f.web)


def q_funnel_by_campaign(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return funnel.funnel_table(f.web)


def q_funnel_long(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return funnel.funnel_long_of(materialize_small(funnel.funnel_by_campaign(f.web)))


def q_funnel_coarse(spark, sf_dir):
    return funnel.funnel_coarse(_channel_kpis(spark, sf_dir))


# ------------------------------------------------------------------ CAC, cohorts
def q_cac_daily(spark, sf_dir):
    b = _binding(spark, sf_dir)
    f = _filtered(spark, sf_dir, b)
    return growth.cac_daily(f.ads, b.orders(), START, END)


def q_cac_daily_range(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return growth.cac_daily_range(f.ads, f.od)


def q_ltv_by_cohort(spark, sf_dir):
    return growth.ltv_by_cohort(_binding(spark, sf_dir).cohort_orders(), 180)


def q_retention_rates(spark, sf_dir):
    return growth.retention_rates(_binding(spark, sf_dir).cohort_orders())


def q_retention_matrix(spark, sf_dir):
    """R4 as its dense cells: a view-safe shape whose columns do not depend on the data."""
    return growth.retention_cells(growth.retention_rates(_binding(spark, sf_dir).cohort_orders(), sort=False))


def q_retention_90d(spark, sf_dir):
    return growth.retention_90d(_binding(spark, sf_dir).cohort_orders(), 90)


def q_growth_summary(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    g = growth.growth_summary(growth.ltv_horizon(f.od, 180), growth.cac_daily_range(f.ads, f.od))
    return g.select(*[F.round(c, FLOAT_PLACES).alias(c) for c in g.columns])


def q_ltv_table(spark, sf_dir):
    return budget.ltv_table(growth.ltv_horizon(_binding(spark, sf_dir).cohort_orders(), 180))


# ------------------------------------------------------------------ attribution
def q_attribution_models(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    m = attribution.attribution_models(f.web, f.od)
    return m.withColumns({c: F.round(c, 4) for c in ("revenue_linear", "revenue_time_decay")})


def q_last_touch(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return attribution.attribution(f.web, f.od, "last_touch")


def q_last_touch_before_order(spark, sf_dir):
    """D20's flag: the latest touch at or before each order."""
    f = _filtered(spark, sf_dir)
    return attribution.last_touch_attribution(f.web, f.od, before_order=True)


# spend and revenue in fractions of a cent, exact in both engines
def _subcent(df, col, factor):
    return df.withColumn(col, F.col(col).cast("decimal(18,4)") * F.lit(factor).cast("decimal(2,2)"))


def q_paid_perf_subcent(spark, sf_dir):
    """P1-P4 over money below a cent: nothing is rounded before it is summed."""
    f = _filtered(spark, sf_dir)
    return paid.paid_perf_daily(_subcent(f.ads, "spend", "0.13"), _subcent(f.od, "revenue", "0.07"))


def q_attribution_subcent(spark, sf_dir):
    """A1-A6 over money below a cent; a low bound on light users, so that both ways have some."""
    f = _filtered(spark, sf_dir)
    m = attribution.attribution_models(f.web, _subcent(f.od, "revenue", "0.07"), hot=200)
    return m.withColumns({c: F.round(c, 4) for c in ("revenue_linear", "revenue_time_decay")})


def q_attribution_lookback(spark, sf_dir):
    """A1-A6 over touches of the seven days before an order."""
    f = _filtered(spark, sf_dir)
    m = attribution.attribution_models(f.web, f.od, lookback_days=7)
    return m.withColumns({c: F.round(c, 4) for c in ("revenue_linear", "revenue_time_decay")})


def q_order_campaign_credit(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return attribution.attribution(f.web, f.od, "order_campaign")


def q_attribution_table(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return budget.attribution_table(attribution.last_touch_attribution(f.web, f.od))


# ------------------------------------------------------------------ SQL table functions
def _sql_views(spark, sf_dir):
    b = _binding(spark, sf_dir)
    register_views(spark, {"ads_daily": b.ads(), "web_events": b.web(), "orders": b.orders(), "customers": b.customers()})
    register_functions(spark)


def q_sql_orders_in(spark, sf_dir):
    """F1 + F2 as a table function."""
    _sql_views(spark, sf_dir)
    return spark.sql("SELECT order_id, channel, campaign, CAST(order_ts AS DATE) AS dt FROM orders_in(:first, :last, :channels, :campaigns)",
                     args={"first": dt.date.fromisoformat(START), "last": dt.date(2024, 1, 20),
                           "channels": F.array(*map(F.lit, SEL_CHANNELS)), "campaigns": F.array(*map(F.lit, SEL_CAMPAIGNS))})


def q_sql_ads_in(spark, sf_dir):
    """F1 as a table function without lists, summed by channel in the SQL of a user."""
    _sql_views(spark, sf_dir)
    return spark.sql("SELECT channel, sum(impressions) AS impressions, sum(clicks) AS clicks FROM ads_daily_in(:first, :last) GROUP BY channel",
                     args={"first": dt.date(2024, 1, 5), "last": dt.date(2024, 1, 25)})


def q_sql_attribution_by(spark, sf_dir):
    """A9's selector as a table function: both models side by side."""
    _sql_views(spark, sf_dir)
    at = {"first": dt.date.fromisoformat(START), "last": dt.date.fromisoformat(END)}
    return spark.sql("SELECT 'last_touch' AS model, * FROM attribution_by('last_touch', :first, :last) "
                     "UNION ALL SELECT 'order_campaign' AS model, * FROM attribution_by('order_campaign', :first, :last)", args=at)


# ------------------------------------------------------------------ incrementality
def q_incrementality_uplift(spark, sf_dir):
    b = _binding(spark, sf_dir)
    f = _filtered(spark, sf_dir, b)
    return incrementality.incrementality_uplift(b.exposure(), f.od, 30)


def q_incrementality_keep_all(spark, sf_dir):
    """D11's flag: users whose orders all lie outside the window stay in the denominator."""
    b = _binding(spark, sf_dir)
    f = _filtered(spark, sf_dir, b)
    return incrementality.incrementality_uplift(b.exposure(), f.od, 30, keep_all_exposed=True)


def q_holdout_detail(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    return budget.holdout_table(incrementality.holdout_detail(f.ads, f.od))


def q_holdout_summary(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    s = incrementality.holdout_summary(f.ads, f.od)
    return s.withColumn("value", F.round("value", FLOAT_PLACES))


# ------------------------------------------------------------------ budget
def q_budget_weight(spark, sf_dir):
    k = budget.budget_weight(_channel_kpis(spark, sf_dir, materialize=True))
    return k.select("channel", F.bround("ROAS", 4).alias("ROAS"), F.bround("budget_weight", 4).alias("budget_weight"))


def q_budget_guarded(spark, sf_dir):
    ch = materialize_small(paid.channel_summary(_exact(spark, sf_dir)))
    alloc = budget.guarded_allocation(ch, 200000.0)
    return budget.allocation_table(alloc)


# ------------------------------------------------------------------ filters, validation
def q_filter_options(spark, sf_dir):
    b = _binding(spark, sf_dir)
    return filters.filter_options(b.ads(), b.orders(), b.web())


def q_date_bounds(spark, sf_dir):
    b = _binding(spark, sf_dir)
    return filters.date_bounds(b.ads(), b.orders(), b.web())


def q_filtered_orders(spark, sf_dir):
    b = _binding(spark, sf_dir)
    a, o, w = filters.apply_dashboard_filters(b.ads(), b.orders(), b.web(), START, END,
                                              SEL_CHANNELS, SEL_CAMPAIGNS)
    return o.select("order_id", "user_id", F.to_date("order_ts").alias("dt"),
                    F.col("revenue").cast("double").alias("revenue"), "channel", "campaign")


def q_validate_report(spark, sf_dir):
    return validate.validation_report(raw_tables(spark, sf_dir), mode="strict")


def q_validate_report_coerce(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return validate.validation_report({k: raw[k] for k in ("ads_daily", "orders", "web_events")}, mode="coerce")


def q_unknown_events(spark, sf_dir):
    return validate.unknown_events(raw_tables(spark, sf_dir)["web_events"])


def q_validate_campaign_file(spark, sf_dir):
    """V1, V8, V9 of the campaign file: its binding as an all-string upload."""
    cf = _binding(spark, sf_dir).campaign_daily()
    raw = cf.select(*[F.col(c).cast("string").alias(c) for c in cf.columns])
    return validate.check_table(raw, "campaign_daily", mode="numeric")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "paid_perf_daily": q_paid_perf_daily,
    "paid_daily_zero": q_paid_daily_zero,
    "daily_trend": q_daily_trend,
    "campaign_table": q_campaign_table,
    "top_campaigns": q_top_campaigns,
    "channel_summary": q_channel_summary,
    "kpi_cards": q_kpi_cards,
    "paid_lattice": q_paid_lattice,
    "buyers_distinct": q_buyers_distinct,
    "sessions_distinct": q_sessions_distinct,
    "sql_orders_in": q_sql_orders_in,
    "sql_ads_in": q_sql_ads_in,
    "sql_attribution_by": q_sql_attribution_by,
    "channel_kpi": q_channel_kpi,
    "kpi_cards_channel": q_kpi_cards_channel,
    "campaign_kpis": q_campaign_kpis,
    "campaign_cards": q_campaign_cards,
    "funnel_stage_daily": q_funnel_stage_daily,
    "funnel_by_campaign": q_funnel_by_campaign,
    "funnel_long": q_funnel_long,
    "funnel_coarse": q_funnel_coarse,
    "cac_daily": q_cac_daily,
    "cac_daily_range": q_cac_daily_range,
    "ltv_by_cohort": q_ltv_by_cohort,
    "retention_rates": q_retention_rates,
    "retention_matrix": q_retention_matrix,
    "retention_90d": q_retention_90d,
    "growth_summary": q_growth_summary,
    "ltv_table": q_ltv_table,
    "attribution_models": q_attribution_models,
    "last_touch": q_last_touch,
    "last_touch_before_order": q_last_touch_before_order,
    "paid_perf_subcent": q_paid_perf_subcent,
    "attribution_subcent": q_attribution_subcent,
    "attribution_lookback": q_attribution_lookback,
    "order_campaign_credit": q_order_campaign_credit,
    "attribution_table": q_attribution_table,
    "incrementality_uplift": q_incrementality_uplift,
    "incrementality_keep_all": q_incrementality_keep_all,
    "holdout_detail": q_holdout_detail,
    "holdout_summary": q_holdout_summary,
    "budget_weight": q_budget_weight,
    "budget_guarded": q_budget_guarded,
    "filter_options": q_filter_options,
    "date_bounds": q_date_bounds,
    "filtered_orders": q_filtered_orders,
    "validate_report": q_validate_report,
    "validate_report_coerce": q_validate_report_coerce,
    "unknown_events": q_unknown_events,
    "validate_campaign_file": q_validate_campaign_file,
}
