"""Mart pipeline (write once, preview from the written marts) and dashboards."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from mktpulse.plans import marts as M
from mktpulse.sources.bindings import Binding


def test_marts_write_and_preview(spark):
    b = Binding(spark, SF001)
    params = M.MartParams("2024-01-01", "2024-01-31")
    built = M.build_marts(b.ads(), b.web(), b.orders(), b.customers(), b.exposure(), params)
    assert len(built) == 7
    out = tempfile.mkdtemp(prefix="mktpulse-marts-")
    names = M.write_marts(built, out)
    assert set(names) == set(built)
    assert os.path.isdir(os.path.join(out, "mart_paid_perf_daily", "dt=2024-01-01"))
    pv = M.previews(spark, names, out)
    assert pv["mart_paid_perf_daily"].count() == 50
    assert pv["mart_retention_cohort"].count() <= 100
    first = rows(pv["mart_paid_perf_daily"].limit(1))[0]
    assert str(first["dt"]) == "2024-01-30"  # latest day first
    # the written mart equals the lazily computed one
    a = built["mart_ltv_cohort"].orderBy("cohort_month").collect()
    c = M.read_mart(spark, "mart_ltv_cohort", out).select(*built["mart_ltv_cohort"].columns)
    assert a == c.orderBy("cohort_month").collect()


def test_optional_exposure_skipped(spark):
    b = Binding(spark, SF001)
    built = M.build_marts(b.ads(), b.web(), b.orders(), None, None,
                          M.MartParams("2024-01-01", "2024-01-31"))
    assert "mart_incrementality_uplift" not in built


def test_growth_dashboard(spark):
    b = Binding(spark, SF001)
    g = M.growth_dashboard(b.ads(), b.orders(), b.web(), M.GrowthParams("2024-01-01", "2024-01-31", top_n=5))
    assert g["top_campaigns"].count() == 5
    alloc = rows(g["allocation"])
    assert abs(sum(r["rec_budget"] for r in alloc) - 200000) <= len(alloc)
    assert rows(g["kpi_cards"])[0]["total_orders"] > 0
    assert g["retention_matrix"].count() == 1
    for p in (M.GrowthParams("2030-01-01", "2030-01-31"), M.GrowthParams("2024-01-01", "2024-01-31", channels=["none"])):
        with pytest.raises(M.NoRows, match="ads_daily, orders"):
            M.growth_dashboard(b.ads(), b.orders(), b.web(), p)


def test_a_day_can_be_several_files(spark):
    days = spark.range(4000).selectExpr("date'2024-01-01' AS dt", "id AS n")
    out = tempfile.mkdtemp(prefix="mktpulse-days-")
    M.write_marts({"mart_paid_perf_daily": days}, out, files_per_day=4)
    files = [f for f in os.listdir(os.path.join(out, "mart_paid_perf_daily", "dt=2024-01-01")) if f.endswith(".parquet")]
    assert 2 <= len(files) <= 4
    assert M.read_mart(spark, "mart_paid_perf_daily", out).agg({"n": "sum"}).first()[0] == 3999 * 2000


def test_channel_and_campaign_file_dashboards(spark):
    b = Binding(spark, SF001)
    c = M.channel_dashboard(b.ads(), b.orders(), "2024-01-01", "2024-01-31")
    assert {r["stage"] for r in rows(c["funnel"])} == {"Impressions", "Clicks", "Orders"}
    raw = b.campaign_daily().select(*[F.col(x).cast("string").alias(x) for x in b.campaign_daily().columns])
    raw = raw.union(spark.createDataFrame([("not a date", "X", "1", "1", "1.0", "1", "1.0", "1.0")], raw.schema))
    with pytest.raises(M.ValidationFailed):  # a bad row stops, unless it is to be set aside
        M.campaign_file_dashboard(raw)
    f = M.campaign_file_dashboard(raw, quarantine=True)
    rep = {(r["check"], r["column"]): r["violations"] for r in rows(f["report"])}
    assert rep[("parse_date", "dt")] == 1 and rep[("parse_int", "orders")] == 0
    assert f["quarantine"].count() == 1
    assert rows(f["cards"])[0]["total_orders"] == rows(b.campaign_daily().agg(F.sum("orders").alias("n")))[0]["n"]


def test_marts_as_managed_tables(spark):
    b = Binding(spark, SF001)
    built = {"mart_cac_daily": M.build_marts(b.ads(), b.web(), b.orders(), None, None,
                                             M.MartParams("2024-01-01", "2024-01-31"))["mart_cac_daily"]}
    assert M.write_marts(built, as_tables=True) == ["mart_cac_daily"]
    assert spark.catalog.tableExists("mart_cac_daily")
    pv = M.previews(spark, ["mart_cac_daily"])["mart_cac_daily"]
    assert pv.count() == 30 and str(rows(pv.limit(1))[0]["dt"]) == "2024-01-30"


def test_marts_from_one_roll_up(spark):
    """The three marts over all orders read the stored (user, day) rows, and give the same rows."""
    b, params = Binding(spark, SF001), M.MartParams("2024-01-05", "2024-01-25")
    od = b.orders().union(b.orders().limit(20).withColumn("user_id", F.lit(None).cast("string")))
    alone = M.build_marts(b.ads(), b.web(), od, None, None, params)
    shared = M.build_marts(b.ads(), b.web(), od, None, None, params, share=True)
    for name, scans in (("mart_cac_daily", 1), ("mart_ltv_cohort", 0), ("mart_retention_cohort", 0)):  # CAC reads the ads
        assert shared[name]._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == scans
        assert sorted(map(str, alone[name].collect())) == sorted(map(str, shared[name].collect()))
