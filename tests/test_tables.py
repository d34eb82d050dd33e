"""SQL table functions, bucketed tables, days replaced in place, uploads read once."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001, SF01, rows
from mktpulse.operators import attribution, filters, growth, validate
from mktpulse.plans import marts as M
from mktpulse.sources import bucketed
from mktpulse.sources.bindings import Binding
from mktpulse.sources.readers import read_csv_raw, register_views
from mktpulse.sources.table_functions import register_functions


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def views(spark):
    b = Binding(spark, SF01)
    register_views(spark, {"ads_daily": b.ads(), "web_events": b.web(), "orders": b.orders(), "customers": b.customers()})
    assert set(register_functions(spark)) == {"ads_daily_in", "orders_in", "web_events_in", "attribution_by"}
    return b


def test_table_functions_equal_the_operators(spark, views):
    got = spark.sql("SELECT * FROM orders_in(DATE'2024-01-03', DATE'2024-01-09', array('Meta'), array('Always_On', 'nothing'))")
    want = filters.membership(filters.date_range(views.orders(), "order_ts", "2024-01-03", "2024-01-09", None), ["Meta"], ["Always_On"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    assert spark.sql("SELECT * FROM web_events_in(DATE'2024-01-03', DATE'2024-01-03')").count() == views.web().where(
        "to_date(event_ts) = '2024-01-03'").count()
    assert spark.sql("SELECT * FROM ads_daily_in(DATE'2030-01-03', DATE'2030-01-03')").collect() == []
    for model in ("last_touch", "order_campaign"):
        got = spark.sql("SELECT * FROM attribution_by(:m, DATE'2024-01-01', DATE'2024-01-31')", args={"m": model})
        want = attribution.attribution(views.web(), views.orders(), model)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_table_functions_push_the_range_and_prune_the_other_model(spark, views):
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = spark.sql("SELECT * FROM orders_in(DATE'2024-01-03', DATE'2024-01-09')")._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(ts,2024-01-03" in text and "LessThan(ts,2024-01-10" in text
    one = _plan(spark.sql("SELECT * FROM attribution_by('order_campaign', DATE'2024-01-01', DATE'2024-01-31')"))
    assert len(re.findall("FileScan parquet", one)) == 1 and "Join" not in one


def test_bucketed_tables_need_no_exchange_by_user(spark):
    b = Binding(spark, SF01)
    name = f"m{uuid.uuid4().hex[:8]}"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        od = bucketed.write_bucketed(b.cohort_orders(), f"{name}_o", 6, sort_by="order_ts")
        web = bucketed.write_bucketed(b.web(), f"{name}_w", 6, sort_by="event_ts", files_per_bucket=2)
        assert bucketed.is_bucketed(spark, f"{name}_o") and od.count() == b.cohort_orders().count()
        assert sorted(map(str, web.collect())) == sorted(map(str, b.web().select(*web.columns).collect()))
        w = Window.partitionBy("user_id").orderBy("order_ts")
        for df in (od.withColumn("n", F.row_number().over(w)), growth.first_order(od), od.join(web, "user_id"),
                   growth.user_days(od).drop("revenue")):
            assert not re.findall(r"Exchange hashpartitioning\(user_id", _plan(df)), _plan(df)
        for op in (growth.retention_rates, lambda x: growth.ltv_by_cohort(x, 180), growth.retention_90d):
            plan = _plan(op(od))
            assert not re.findall(r"Exchange hashpartitioning\(user_id", plan)
            assert sorted(map(str, op(od).collect())) == sorted(map(str, op(b.cohort_orders()).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("o", "w"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def _files(folder):
    return {d: sorted(f for f in os.listdir(os.path.join(folder, d)) if f.endswith(".parquet"))
            for d in os.listdir(folder) if d.startswith("dt=")}


def test_a_day_is_replaced_in_place(spark):
    b = Binding(spark, SF001)
    params = M.MartParams("2024-01-01", "2024-01-31")
    built = M.build_marts(b.ads(), b.web(), b.orders(), None, None, params)
    out = tempfile.mkdtemp(prefix="mktpulse-marts-")
    M.write_marts(built, out)
    folder = os.path.join(out, "mart_paid_perf_daily")
    before, want = _files(folder), sorted(map(str, M.read_mart(spark, "mart_paid_perf_daily", out).collect()))
    ltv = sorted(os.listdir(os.path.join(out, "mart_ltv_cohort")))
    for _ in range(2):  # a rerun gives the same rows
        assert set(M.write_marts(built, out, days=("2024-01-10", "2024-01-11"))) == {"mart_paid_perf_daily", "mart_funnel_stage_daily", "mart_cac_daily"}
        after = _files(folder)
        changed = {d for d in before if before[d] != after.get(d)}
        assert changed == {"dt=2024-01-10", "dt=2024-01-11"} and set(after) == set(before)
        assert sorted(map(str, M.read_mart(spark, "mart_paid_perf_daily", out).collect())) == want
    assert sorted(os.listdir(os.path.join(out, "mart_ltv_cohort"))) == ltv
    # a day that lost its rows goes; its neighbours stay
    gone = {"mart_paid_perf_daily": built["mart_paid_perf_daily"].where("dt <> '2024-01-11'"), "mart_cac_daily": None}
    assert M.write_marts(gone, out, days=("2024-01-10", "2024-01-11")) == ["mart_paid_perf_daily"]
    assert set(_files(folder)) == set(before) - {"dt=2024-01-11"}
    with pytest.raises(ValueError):
        M.write_marts(built, as_tables=True, days=("2024-01-10", "2024-01-10"))


def test_days_into_an_empty_folder(spark):
    df = spark.createDataFrame([(date(2024, 1, i), i) for i in range(1, 6)], "dt date, n int")
    out = tempfile.mkdtemp(prefix="mktpulse-marts-")
    M.write_marts({"mart_cac_daily": df}, out, days=("2024-01-02", "2024-01-03"))
    assert [r["n"] for r in rows(M.read_mart(spark, "mart_cac_daily", out), ["n"])] == [2, 3]


def _csv(folder, name, text):
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_uploads_are_read_once(spark, monkeypatch):
    """The report equals the one of the separate check; the registered tables scan the written rows, not the CSV."""
    folder = tempfile.mkdtemp(prefix="mktpulse-up-")
    paths = {
        "ads_daily": _csv(folder, "ads", "dt,channel,campaign,impressions,clicks,spend\n2025-12-01,Meta,W,1000,10,50.0\n2025-12-02,Meta,W,1000,1.5,\n"),
        "orders": _csv(folder, "orders", "order_id,user_id,order_ts,revenue,cost,channel,campaign\nO1,U1,2025-12-01 10:00:00,10.0,5.0,Meta,W\n"),
        "web_events": _csv(folder, "web", "user_id,session_id,event_ts,event_name,device,source,medium,campaign\nU1,S1,2025-12-01 09:00:00,page_view,mobile,Meta,paid,W\n"),
        "customers": _csv(folder, "cust", "user_id,first_seen_ts\nU1,2025-12-01 09:00:00\n"),
        "exposure_holdout": _csv(folder, "exp", "user_id,campaign,group,exposure_ts\nU1,W,neither,2025-12-01 09:00:00\nU2,W,Test,2025-12-01 09:00:00\n"),
    }
    out = M.load_uploads(spark, paths)
    raw = {t: read_csv_raw(spark, p, ragged=True) for t, p in paths.items()}
    want = validate.validation_report(raw, "strict", dashboard="main")
    assert sorted(map(str, out["report"].collect())) == sorted(map(str, want.collect()))
    assert out["skipped"] == ["exposure_holdout"] and out["quarantine"]["exposure_holdout"].count() == 1
    assert out["quarantine"]["ads_daily"].count() == 0
    for t, df in out["tables"].items():
        assert "csv" not in _plan(df).lower() and df.columns == raw[t].drop("_ragged").columns[:len(df.columns)]
    assert spark.table("ads_daily").count() == 2
    bad = dict(paths, ads_daily=_csv(folder, "bad", "dt,channel,campaign,impressions,clicks,spend\nnever,Meta,W,x,10,50.0\n"),
               orders=_csv(folder, "none", "order_id,user_id,order_ts,revenue,cost,channel,campaign\n"))
    with pytest.raises(M.ValidationFailed) as e:
        M.load_uploads(spark, bad)
    assert set(e.value.failed) == {"ads_daily", "orders"}
    found = {(r["table"], r["check"], r["column"]): r["violations"] for r in rows(e.value.report)}
    assert found["ads_daily", "parse_date", "dt"] == 1 and found["ads_daily", "parse_int", "impressions"] == 1
    assert found["orders", "non_empty", None] == 1
