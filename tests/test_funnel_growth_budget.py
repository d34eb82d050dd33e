"""Funnel, CAC, cohorts, budget: hand-computed cases and invariants."""

from __future__ import annotations

from decimal import Decimal

import pytest

from conftest import d, rows, ts
from mktpulse.operators import budget, funnel, growth

WEB = ("user_id string, session_id string, event_ts timestamp, event_name string, device string, "
       "source string, medium string, campaign string")
ORD = "order_id string, user_id string, order_ts timestamp, revenue decimal(18,2)"


@pytest.fixture
def web(spark):
    t = ts("2025-12-01 10:00:00")
    rs = [("U-501", "S-9001", t, e, "mobile", "Meta", "paid", "Winter_Sale")
          for e in ["page_view", "product_view", "add_to_cart", "begin_checkout"]]
    rs += [("U-502", "S-9002", t, "page_view", "mobile", "Meta", "paid", "Winter_Sale"),
           ("U-502", "S-9002", t, "page_view", "mobile", "Meta", "paid", "Winter_Sale"),   # same session
           ("U-503", "S-9003", t, "page_view", "desktop", "Google", "paid", "Sale"),
           ("U-503", "S-9003", t, "purchase", "desktop", "Google", "paid", "Sale"),        # unknown event
           ("U-504", "S-9004", t, "page_view", "desktop", "Google", "paid", None)]
    return spark.createDataFrame(rs, WEB)


def test_funnel_stage_daily(web):
    out = {(r["campaign"], r["funnel_stage"]): r["sessions"] for r in rows(funnel.funnel_stage_daily(web))}
    assert out[("Winter_Sale", "session")] == 2 and out[("Winter_Sale", "checkout")] == 1
    assert ("Sale", "purchase") not in out and (None, "session") in out


def test_funnel_by_campaign_and_long(web):
    f = {r["campaign"]: r for r in rows(funnel.funnel_by_campaign(web))}
    ws = f["Winter_Sale"]
    assert (ws["page_view"], ws["product_view"], ws["add_to_cart"], ws["begin_checkout"]) == (2, 1, 1, 1)
    assert ws["pdp_rate"] == 0.5 and ws["atc_rate"] == 1.0 and ws["checkout_rate"] == 1.0
    assert f["Sale"]["product_view"] == 0 and f["Sale"]["pdp_rate"] == 0.0 and f["Sale"]["atc_rate"] == 0.0
    table = rows(funnel.funnel_table(web))
    assert table[0]["campaign"] == "Winter_Sale"
    long = rows(funnel.funnel_long(web))
    assert {r["campaign"] for r in long} == {"Sale"}  # first in sorted order
    assert [r["stage"] for r in long] == funnel.STAGE_TITLES


def test_funnel_coarse(spark):
    k = spark.createDataFrame([(10, 3, 1), (5, 2, 2)], "impressions bigint, clicks bigint, orders bigint")
    assert {r["stage"]: r["count"] for r in rows(funnel.funnel_coarse(k))} == {
        "Impressions": 15, "Clicks": 5, "Orders": 3}


@pytest.fixture
def cohort_orders(spark):
    return spark.createDataFrame([
        ("1", "a", ts("2024-01-05 00:00:00"), Decimal("10.00")),
        ("2", "a", ts("2024-02-10 00:00:00"), Decimal("20.00")),
        ("3", "a", ts("2024-09-10 00:00:00"), Decimal("40.00")),   # 249 days later
        ("4", "b", ts("2024-01-20 00:00:00"), Decimal("5.00")),
        ("5", "c", ts("2024-02-01 00:00:00"), Decimal("7.00")),
        ("6", "c", ts("2024-02-01 12:00:00"), Decimal("1.00")),    # same day as the first
        ("7", None, ts("2024-01-01 00:00:00"), Decimal("99.00")),  # NULL user never has a cohort
    ], ORD)


def test_ltv(cohort_orders):
    l = {r["cohort_month"]: r for r in rows(growth.ltv_by_cohort(cohort_orders, 180))}
    jan, feb = l[d("2024-01-01")], l[d("2024-02-01")]
    assert jan["customers"] == 2 and jan["revenue_lookback"] == 35.0 and jan["LTV_lookback"] == 17.5
    assert feb["customers"] == 1 and feb["revenue_lookback"] == 8.0
    longer = {r["cohort_month"]: r for r in rows(growth.ltv_by_cohort(cohort_orders, 365))}
    assert longer[d("2024-01-01")]["revenue_lookback"] == 75.0  # LTV grows with the lookback


def test_retention(cohort_orders):
    r = {(x["cohort_month"], x["months_since_cohort"]): x for x in rows(growth.retention_rates(cohort_orders))}
    assert r[(d("2024-01-01"), 0)]["retention_rate"] == 1.0 and r[(d("2024-01-01"), 0)]["cohort_size"] == 2
    assert r[(d("2024-01-01"), 1)]["active_customers"] == 1 and r[(d("2024-01-01"), 1)]["retention_rate"] == 0.5
    assert r[(d("2024-01-01"), 8)]["retention_rate"] == 0.5
    assert all(v["retention_rate"] == 1.0 for (c, m), v in r.items() if m == 0)
    m = {x["cohort_month"]: x for x in rows(growth.retention_matrix(growth.retention_rates(cohort_orders)))}
    assert m[d("2024-02-01")]["0"] == 1.0 and m[d("2024-02-01")]["1"] == 0.0
    cells = {(x["cohort_month"], x["months_since_cohort"]): x["retention_rate"]
             for x in rows(growth.retention_cells(growth.retention_rates(cohort_orders)))}
    assert cells == {(c, int(i)): x[i] for c, x in m.items() for i in x if i != "cohort_month" for i in [i]} | {
        k: v for k, v in cells.items() if str(k[1]) not in m[k[0]]} and all(
        v == 0.0 for k, v in cells.items() if str(k[1]) not in m[k[0]])
    assert {i for _, i in cells} == set(range(max(i for _, i in cells) + 1))
    r90 = rows(growth.retention_90d(cohort_orders))[0]
    assert r90["users"] == 3 and r90["retention_rate"] == 1.0  # always 1, as in the reference
    assert r90["repeat_users"] == 1  # only "a" reorders within 1..90 days


def test_cac(spark, cohort_orders):
    ads = spark.createDataFrame([(d("2024-01-05"), 100.0), (d("2024-01-06"), 50.0), (d("2024-02-10"), 30.0)],
                                "dt date, spend double")
    c = {r["dt"]: r for r in rows(growth.cac_daily(ads, cohort_orders, "2024-01-01", "2024-12-31"))}
    assert c[d("2024-01-05")]["new_buyers"] == 1 and c[d("2024-01-05")]["CAC"] == 100.0
    assert c[d("2024-01-06")]["new_buyers"] == 0 and c[d("2024-01-06")]["CAC"] is None
    assert c[d("2024-02-10")]["new_buyers"] == 0  # "a" is not new in February
    later = cohort_orders.filter("order_ts >= '2024-02-01'")
    cr = {r["dt"]: r for r in rows(growth.cac_daily_range(ads, later))}
    assert cr[d("2024-02-10")]["new_buyers"] == 1  # first within the filtered range (C4)
    ltv = growth.ltv_horizon(cohort_orders)
    g = rows(growth.growth_summary(ltv, growth.cac_daily(ads, cohort_orders, "2024-01-01", "2024-12-31")))[0]
    assert g["avg_CAC"] == 100.0 and g["CLV"] == g["avg_LTV"] - 100.0


def _ch(spark, roas):
    return spark.createDataFrame([(f"c{i}", float(x), 1.0, 1.0, 0.1, 0.1, 1.0) for i, x in enumerate(roas)],
                                 "channel string, ROAS double, spend double, revenue double, CTR double, "
                                 "CVR double, CAC double")


def test_budget_guard_rails(spark):
    eq = rows(budget.guarded_allocation(_ch(spark, [0, 0, 0, 0]), 1000.0))
    assert all(r["rec_share"] == 0.25 for r in eq)
    g = {r["channel"]: r for r in rows(budget.guarded_allocation(_ch(spark, [9.0, 0.5, 0.5]), 1000.0))}
    assert sum(r["rec_share"] for r in g.values()) == pytest.approx(1.0)
    # 0.9 clips to 0.7, 0.05 stays; renormalised once: 0.7 / 0.8
    assert g["c0"]["rec_share"] == pytest.approx(0.7 / 0.8) and g["c0"]["rec_budget"] == pytest.approx(875.0)
    low = {r["channel"]: r for r in rows(budget.guarded_allocation(_ch(spark, [1.0, 0.01]), 100.0))}
    assert low["c1"]["rec_share"] > 0.01 / 1.01  # the 5 % floor lifted it
    t = rows(budget.allocation_table(budget.guarded_allocation(_ch(spark, [3.0, 1.0]), 1000.0)))
    assert t[0]["channel"] == "c0" and t[0]["rec_budget"] == 737.0  # 1000 * 0.70 / 0.95: may leave the bounds


def test_budget_weight_and_rounding(spark):
    w = {r["channel"]: r["budget_weight"] for r in rows(budget.budget_weight(_ch(spark, [3.0, 1.0])))}
    assert w == {"c0": 0.75, "c1": 0.25}
    r = rows(budget.round_numeric(spark.createDataFrame([(0.125, 2.675, 7)], "a double, b double, n bigint"), 2))[0]
    assert r == {"a": 0.12, "b": 2.68, "n": 7}  # half-to-even on the decimal value
