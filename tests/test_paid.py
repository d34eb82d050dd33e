"""Paid performance: hand-computed cases incl. the zero-denominator policies."""

from decimal import Decimal

import pytest

from conftest import d, rows, ts
from mktpulse.operators import paid

ADS = "dt date, channel string, campaign string, impressions bigint, clicks bigint, spend double"
ORD = ("order_id string, user_id string, order_ts timestamp, revenue decimal(18,2), cost decimal(18,2), "
       "channel string, campaign string")


@pytest.fixture
def ads(spark):
    return spark.createDataFrame([
        (d("2024-01-01"), "Meta", "A", 1000, 10, 50.0),
        (d("2024-01-01"), "Meta", "A", 1000, 10, 50.0),     # summed with the row above
        (d("2024-01-01"), "Google", "A", 0, 0, 0.0),         # all denominators zero
        (d("2024-01-02"), "Meta", "A", 500, 5, 20.0),        # no orders that day
        (d("2024-01-02"), None, "A", 100, 1, 1.0),           # NULL channel: its own group
    ], ADS)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([
        ("o1", "u1", ts("2024-01-01 10:00:00"), Decimal("30.00"), Decimal("10.00"), "Meta", "A"),
        ("o2", "u1", ts("2024-01-01 11:00:00"), Decimal("70.00"), Decimal("20.00"), "Meta", "A"),
        ("o2", "u1", ts("2024-01-01 11:00:00"), Decimal("70.00"), Decimal("20.00"), "Meta", "A"),  # dup id
        ("o3", "u2", ts("2024-01-01 12:00:00"), Decimal("5.00"), Decimal("1.00"), "Google", "A"),
        ("o4", "u3", ts("2024-01-03 12:00:00"), Decimal("9.00"), Decimal("1.00"), "Meta", "A"),   # no spend
        ("o5", "u4", ts("2024-01-02 09:00:00"), Decimal("4.00"), Decimal("1.00"), None, "A"),
    ], ORD)


def test_paid_perf_daily_null_policy(ads, orders):
    out = {(r["dt"], r["channel"]): r for r in rows(paid.paid_perf_daily(ads, orders))}
    assert len(out) == 4  # orders without spend (o4) are not reported (D16)
    m = out[(d("2024-01-01"), "Meta")]
    assert (m["impressions"], m["clicks"], m["spend"]) == (2000, 20, 100.0)
    assert m["orders"] == 2 and m["buyers"] == 1          # distinct order ids / users
    assert m["revenue"] == 170.0 and m["margin"] == 120.0
    assert m["CTR"] == 20 / 2000 and m["CPC"] == 5.0 and m["CPM"] == 100.0 * 1000 / 2000
    assert m["CVR_click_to_order"] == 2 / 20 and m["ROAS"] == 1.7 and m["MER"] == m["ROAS"]
    assert m["GM_ROAS"] == 1.2 and m["AOV"] == 85.0
    g = out[(d("2024-01-01"), "Google")]
    assert g["CTR"] is None and g["CPC"] is None and g["CPM"] is None
    assert g["ROAS"] is None and g["CVR_click_to_order"] is None and g["AOV"] == 5.0
    e = out[(d("2024-01-02"), "Meta")]
    assert e["orders"] == 0 and e["revenue"] == 0.0 and e["AOV"] is None
    n = out[(d("2024-01-02"), None)]
    assert n["orders"] == 0  # NULL keys never join


def test_paid_daily_zero_policy(ads, orders):
    out = {(r["dt"], r["channel"]): r for r in rows(paid.paid_daily(ads, orders))}
    g = out[(d("2024-01-01"), "Google")]
    assert g["CTR"] == 0.0 and g["ROAS"] == 0.0 and g["GM_ROAS"] == 0.0 and g["CVR"] == 0.0
    m = out[(d("2024-01-01"), "Meta")]
    assert m["cost"] == 50.0 and m["GM_ROAS"] == (170.0 - 50.0) / 100.0


def test_rollups_and_cards(ads, orders):
    ex = paid.paid_daily_exact(ads, orders)
    trend = {r["dt"]: r for r in rows(paid.daily_trend(ex))}
    assert trend[d("2024-01-01")]["spend"] == 100.0 and trend[d("2024-01-01")]["orders"] == 3
    camp = {(r["channel"], r["campaign"]): r for r in rows(paid.campaign_table(ex))}
    assert camp[("Google", "A")]["CAC"] == 0.0 / 1 and camp[(None, "A")]["CAC"] is None
    top = rows(paid.top_campaigns(ex, 2))
    assert [r["channel"] for r in top] == ["Meta", "Google"]
    card = rows(paid.kpi_cards(ex))[0]
    assert card["total_spend"] == 121.0 and card["total_orders"] == 3 and card["total_buyers"] == 2
    assert card["ROAS"] == 175.0 / 121.0 and card["AOV"] == 175.0 / 3


def test_channel_kpi_unguarded(ads, orders):
    k = {r["channel"]: r for r in rows(paid.channel_kpi(ads, orders))}
    g = k["Google"]
    assert g["CTR"] is None and g["ROAS"] is None  # zero denominators -> NULL, never inf
    m = k["Meta"]
    assert m["orders"] == 4  # count(order_id), duplicates included (D19)
    assert m["customers"] == 2 and m["LTV"] == m["AOV"] * 3 and m["CLV"] == m["LTV"] - m["CAC"]
    cards = rows(paid.kpi_cards_channel(paid.channel_kpi(ads, orders)))[0]
    assert cards["total_spend"] == 121.0


def test_campaign_file_kpis(spark):
    cf = spark.createDataFrame([
        (d("2025-12-01"), "Winter_Sale", 100000, 3200, 4200.0, 260, 780000.0, 410000.0),
        (d("2025-12-02"), "New_Arrivals", 85000, 2800, 3900.0, 210, 640000.0, 350000.0),
        (d("2025-12-03"), "Zero", 0, 0, 0.0, 0, 0.0, 0.0),
    ], "dt date, campaign string, impressions bigint, clicks bigint, spend double, orders bigint, "
       "revenue double, cost double")
    ranked = rows(paid.campaign_ranking(cf))
    assert [r["campaign"] for r in ranked] == ["Winter_Sale", "New_Arrivals", "Zero"]
    assert ranked[0]["GM_ROAS"] == (780000.0 - 410000.0) / 4200.0
    assert ranked[2]["ROAS"] is None
    c = rows(paid.campaign_cards(cf))[0]
    assert c["total_orders"] == 470 and c["ROAS"] == 1420000.0 / 8100.0


def test_money_below_a_cent(spark):
    """Sums keep what a row has below a cent: 1,000 rows of 0.004 are 4, not 0."""
    from mktpulse.operators import growth, incrementality

    ads = spark.range(1000).selectExpr("date'2024-01-01' AS dt", "'Meta' AS channel", "'W' AS campaign", "1L AS impressions",
                                       "1L AS clicks", "0.004D AS spend", "'Test' AS holdout_group")
    od = spark.range(1000).selectExpr("concat('o', id) AS order_id", "'u1' AS user_id", "timestamp'2024-01-01 10:00:00' AS order_ts",
                                      "0.004D AS revenue", "0.001D AS cost", "'Meta' AS channel", "'W' AS campaign")
    p = rows(paid.paid_perf_daily(ads, od))[0]
    assert (p["spend"], p["revenue"], p["margin"], p["ROAS"]) == (4.0, 4.0, 3.0, 1.0)
    z = rows(paid.paid_daily(ads, od))[0]
    assert (z["spend"], z["revenue"], z["cost"]) == (4.0, 4.0, 1.0)
    k = rows(paid.channel_kpi(ads, od))[0]
    assert (k["spend"], k["revenue"]) == (4.0, 4.0)
    assert rows(paid.kpi_cards_channel(paid.channel_kpi(ads, od)))[0]["total_revenue"] == 4.0
    cf = spark.createDataFrame([(0.004, 0.004, 1)] * 1000, "spend double, revenue double, orders int")
    assert rows(paid.campaign_cards(cf))[0]["total_spend"] == 4.0
    assert rows(growth.cac_daily(ads, od, "2024-01-01", "2024-01-31"))[0]["spend"] == 4.0
    assert rows(growth.ltv_by_cohort(od))[0]["revenue_lookback"] == 4.0
    ex = spark.sql("SELECT 'u1' AS user_id, 'W' AS campaign, 'Test' AS `group`, timestamp'2024-01-01 00:00:00' AS exposure_ts")
    assert rows(incrementality.arm_rollup(incrementality.exposed_users(ex, od)))[0]["revenue"] == 4.0
    h = rows(incrementality.holdout_detail(ads, od))
    assert sum(r["spend"] for r in h) == 4.0 and sum(r["revenue"] for r in h) == pytest.approx(4.0)


def test_sums_of_nothing_but_nulls_are_zero_under_the_zero_policy(spark):
    ads = spark.sql("SELECT date'2024-01-01' AS dt, 'Meta' AS channel, 'W' AS campaign, CAST(NULL AS BIGINT) AS impressions, "
                    "CAST(NULL AS BIGINT) AS clicks, CAST(NULL AS DOUBLE) AS spend")
    od = spark.createDataFrame([], "order_id string, user_id string, order_ts timestamp, revenue double, cost double, "
                                   "channel string, campaign string")
    z = rows(paid.paid_daily(ads, od))[0]
    assert (z["impressions"], z["clicks"], z["spend"], z["CTR"], z["ROAS"]) == (0, 0, 0.0, 0.0, 0.0)
