"""One roll-up for four levels, one-pass retention cells, distinct counts from bitmaps: rows and plans."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SF01, rows, ts
from mktpulse.operators import distinct, growth, paid
from mktpulse.plans import catalogue as C
from mktpulse.sources.bindings import Binding


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lattice_levels_equal_the_four_operators(spark):
    b = Binding(spark, SF01)
    exact = paid.paid_daily_exact(b.ads(), b.orders()).cache()
    lattice = paid.paid_lattice(exact).cache()
    _same(paid.lattice_view(lattice, "day"), paid.daily_trend(exact))
    _same(paid.lattice_view(lattice, "campaign"), paid.campaign_table(exact))
    _same(paid.lattice_view(lattice, "channel"), paid.channel_summary(exact))
    _same(paid.lattice_view(lattice, "total"), paid.kpi_cards(exact))
    _same(paid.top_of(paid.lattice_view(lattice, "campaign"), 3), paid.top_campaigns(exact, 3))
    with pytest.raises(ValueError):
        paid.lattice_view(lattice, "week")
    exact.unpersist(), lattice.unpersist()


def test_lattice_scans_each_fact_table_once(spark):
    plan = _plan(C.QUERIES["paid_lattice"](spark, SF01))
    assert len(re.findall("FileScan parquet", plan)) == 2  # ads and orders


def test_lattice_keys_that_are_null_and_no_rows(spark):
    ads = spark.createDataFrame([(date(2024, 1, 1), None, "A", 10, 2, 1.5), (date(2024, 1, 1), "Meta", None, 0, 0, None),
                                 (None, "Meta", "A", 5, 1, 0.25)],
                                "dt date, channel string, campaign string, impressions bigint, clicks bigint, spend double")
    orders = spark.createDataFrame([], "order_id string, user_id string, order_ts timestamp, revenue double, cost double, channel string, campaign string")
    exact = paid.paid_daily_exact(ads, orders)
    lattice = paid.paid_lattice(exact)
    assert {r["level"]: r["n"] for r in rows(lattice.groupBy("level").agg(F.count("*").alias("n")))} == {
        "day": 2, "campaign": 3, "channel": 2, "total": 1}
    for level, op in (("day", paid.daily_trend), ("campaign", paid.campaign_table), ("channel", paid.channel_summary), ("total", paid.kpi_cards)):
        _same(paid.lattice_view(lattice, level), op(exact))
    empty = paid.paid_daily_exact(ads.limit(0), orders)
    _same(paid.lattice_view(paid.paid_lattice(empty), "total"), paid.kpi_cards(empty))


def test_retention_cells_in_one_pass(spark):
    df = C.QUERIES["retention_matrix"](spark, SF01)
    plan = _plan(df)
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Join" not in plan and "BroadcastExchange" not in plan
    cells = rows(df)
    rates = rows(growth.retention_rates(Binding(spark, SF01).cohort_orders()))
    most = max(r["months_since_cohort"] for r in rates)
    want = {(c, i): 0.0 for c in {r["cohort_month"] for r in rates} for i in range(most + 1)}
    want.update({(r["cohort_month"], r["months_since_cohort"]): r["retention_rate"] for r in rates})
    assert {(r["cohort_month"], r["months_since_cohort"]): r["retention_rate"] for r in cells} == want
    none = spark.createDataFrame([], "cohort_month date, months_since_cohort int, retention_rate double")
    assert growth.retention_cells(none).collect() == []


ORDERS = "order_id string, user_id string, order_ts timestamp, revenue double, cost double, channel string, campaign string"


def test_distinct_from_bitmaps(spark):
    data = [(f"o{i}", f"u{i * 7 % 50}" if i % 11 else None, ts(f"2024-01-{1 + i % 9:02d} 10:00:00"), 1.0, 0.5,
             ["Meta", None][i % 2], ["A", "B", None][i % 3]) for i in range(600)]
    data += [(f"h{i}", "hot", ts(f"2024-01-{1 + i % 9:02d} 11:00:00"), 1.0, 0.5, "Meta", "A") for i in range(300)]
    od = spark.createDataFrame(data, ORDERS)
    got = {(r["channel"], r["campaign"]): (r["buyers"], r["buyers_distinct"]) for r in rows(distinct.buyers_by_campaign(od))}
    want = {}
    for ch, ca in {(r[5], r[6]) for r in data}:
        mine = [(r[1], r[2].date()) for r in data if (r[5], r[6]) == (ch, ca) and r[1] is not None]
        want[ch, ca] = len(set(mine)), len({u for u, _ in mine})
    assert got == want


def test_any_level_from_the_same_bitmaps(spark):
    """Facts are read for the bitmaps only; ranges and levels come from the stored day rows."""
    od = Binding(spark, SF01).orders()
    ids = distinct.dictionary(od, "user_id", partitions=3)
    assert ids.count() == od.select("user_id").distinct().count() == ids.select("id").distinct().count()
    days = distinct.bitmaps(od, ids, "user_id", [F.to_date("order_ts").alias("dt"), "channel", "campaign"]).checkpoint()
    for by in ([], ["channel"], ["dt"], ["channel", "campaign"]):
        want = od.withColumn("dt", F.to_date("order_ts")).groupBy(*by).agg(F.countDistinct("user_id").alias("n"))
        _same(distinct.distinct_of(days, by), want.select(*by, "n"))
    part = days.where("dt BETWEEN '2024-01-05' AND '2024-01-12'")
    assert distinct.distinct_of(part, []).first()["n"] == od.where(
        "to_date(order_ts) BETWEEN '2024-01-05' AND '2024-01-12'").agg(F.countDistinct("user_id")).first()[0]
    assert "FileScan parquet" not in _plan(distinct.distinct_of(days, [])).replace("checkpoint", "")


def test_distinct_of_nothing(spark):
    od = spark.createDataFrame([], ORDERS)
    assert distinct.buyers_by_campaign(od).collect() == []
    assert distinct.distinct_of(distinct.bitmaps(od, distinct.dictionary(od, "user_id"), "user_id", ["channel"]), []).first()["n"] == 0
