"""Upload path: CSV read (S1) -> validation -> typed parse -> views (S3/S4/S6) -> mart."""

from __future__ import annotations

import os
import tempfile

import pytest

from conftest import rows
from mktpulse.operators import paid, validate
from mktpulse.sources import read_csv_raw, register_views, table


def _write(dirname, name, text):
    path = os.path.join(dirname, f"{name}.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_upload_to_mart(spark):
    d = tempfile.mkdtemp(prefix="mktpulse-csv-")
    ads = _write(d, "ads_daily", "campaign,dt,channel,impressions,clicks,spend,geo,holdout_group\n"
                                  "Winter_Sale,2025-12-01,Meta,120000,3200,4200.0,Delhi,Test\n"
                                  "Winter_Sale,2025-12-01,Google,90000,2400.0,3800.0,Mumbai,Control\n")
    od = _write(d, "orders", "order_id,user_id,order_ts,revenue,cost,channel,campaign\n"
                             "ORD-1001,U-501,2025-12-01 10:00:00,3499.0,1600.0,Meta,Winter_Sale\n"
                             "ORD-1002,U-777,2025-12-02,2799.0,1300.0,Google,Winter_Sale\n")
    web = _write(d, "web_events", "user_id,session_id,event_ts,event_name,device,source,medium,campaign\n"
                                  "U-501,S-9001,2025-12-01 09:00:00,page_view,mobile,Meta,paid,Winter_Sale\n")
    cu = _write(d, "customers", "user_id,first_seen_ts\nU-501,2025-11-20 00:00:00\n")
    raw = {"ads_daily": read_csv_raw(spark, ads), "orders": read_csv_raw(spark, od),
           "web_events": read_csv_raw(spark, web), "customers": read_csv_raw(spark, cu)}
    assert raw["ads_daily"].columns[0] == "campaign"  # header order kept, matched by name
    report = validate.validation_report(raw, allow_extra=False)
    assert rows(validate.gate(report)) and all(r["ok"] for r in rows(validate.gate(report)))
    typed = {k: validate.split_clean(validate.typed(v, k))[0] for k, v in raw.items()}
    names = register_views(spark, {**typed, "exposure_holdout": None})
    assert names == ["ads_daily", "web_events", "orders", "customers"]
    assert table(spark, "exposure_holdout") is None
    mart = {r["channel"]: r for r in rows(paid.paid_perf_daily(table(spark, "ads_daily"), table(spark, "orders")))}
    assert mart["Meta"]["orders"] == 1 and mart["Meta"]["revenue"] == 3499.0
    assert mart["Google"]["clicks"] == 2400 and mart["Google"]["orders"] == 0  # order lands on 12-02
    with pytest.raises(ValueError):
        register_views(spark, {"ads_daily": typed["ads_daily"]})


def test_load_uploads_gate_and_optional_skip(spark):
    from mktpulse.plans.marts import MartParams, ValidationFailed, build_marts, load_uploads

    d = tempfile.mkdtemp(prefix="mktpulse-up-")
    paths = {
        "ads_daily": _write(d, "ads_daily", "dt,channel,campaign,impressions,clicks,spend\n"
                                            "2025-12-01,Meta,W,1000,10,50.0\n"),
        "orders": _write(d, "orders", "order_id,user_id,order_ts,revenue,cost,channel,campaign\n"
                                      "O1,U1,2025-12-01 10:00:00,30.0,10.0,Meta,W\n"),
        "web_events": _write(d, "web_events", "user_id,session_id,event_ts,event_name,device,source,medium,campaign\n"
                                              "U1,S1,2025-12-01 09:00:00,page_view,mobile,Meta,paid,W\n"),
        "customers": _write(d, "customers", "user_id,first_seen_ts\nU1,2025-11-20 00:00:00\n"),
        "exposure_holdout": _write(d, "exposure_holdout", "user_id,campaign,group,exposure_ts\n"
                                                          "U1,W,holdout,2025-12-01 00:00:00\n"),  # bad group
    }
    out = load_uploads(spark, paths)
    assert out["skipped"] == ["exposure_holdout"]
    t = out["tables"]
    marts = build_marts(t["ads_daily"], t["web_events"], t["orders"], t["customers"], None,
                        MartParams("2025-12-01", "2025-12-31"))
    assert rows(marts["mart_paid_perf_daily"])[0]["ROAS"] == 30.0 / 50.0
    bad = dict(paths, orders=_write(d, "orders_bad", "order_id,user_id,order_ts,revenue,cost,channel,campaign\n"
                                                     "O1,U1,not-a-time,30.0,10.0,Meta,W\n"))
    with pytest.raises(ValidationFailed) as e:
        load_uploads(spark, bad)
    assert e.value.failed == ["orders"]


ADS = "dt,channel,campaign,impressions,clicks,spend"
ORD = "order_id,user_id,order_ts,revenue,cost,channel,campaign"


def _growth(d, ads_rows, more=""):
    return {
        "ads_daily": _write(d, "ads", f"{ADS},geo\n{ads_rows}"),
        "orders": _write(d, "ord", f"{ORD}\nO1,U1,2025-12-01 10:00:00,30.0,10.0,Meta,W\n"),
        "web_events": _write(d, "web", "user_id,session_id,event_ts,event_name,source,medium,campaign,page\n"
                                       "U1,S1,2025-12-01 09:00:00,purchase_done,Meta,paid,W,/home\n" + more)}


def test_growth_upload(spark):
    """Three tables, no device, other columns kept, unknown events only a warning."""
    from mktpulse.plans.marts import ValidationFailed, load_uploads

    d = tempfile.mkdtemp(prefix="mktpulse-growth-")
    out = load_uploads(spark, _growth(d, "2025-12-01,Meta,W,1000,10,50.0,Delhi\n"), "growth")
    t = out["tables"]
    assert set(t) == {"ads_daily", "orders", "web_events"} and t["web_events"].columns[-1] == "page"
    assert rows(t["ads_daily"])[0]["geo"] == "Delhi"
    assert rows(table(spark, "orders"))[0]["revenue"] == 30.0
    with pytest.raises(ValidationFailed, match="ads_daily"):  # coerce: a missing number is an error here
        load_uploads(spark, _growth(d, "2025-12-01,Meta,W,1000,10,NaN,Delhi\n"), "growth")


def test_strict_upload_rejects_other_columns(spark):
    from mktpulse.plans.marts import ValidationFailed, load_uploads

    d = tempfile.mkdtemp(prefix="mktpulse-strict-")
    paths = _growth(d, "2025-12-01,Meta,W,1000,10,50.0,Delhi\n")
    paths["web_events"] = _write(d, "web4", "user_id,session_id,event_ts,event_name,device,source,medium,campaign\n"
                                            "U1,S1,2025-12-01 09:00:00,page_view,mobile,Meta,paid,W\n")
    paths["customers"] = _write(d, "cust", "user_id,first_seen_ts\nU1,2025-11-20 00:00:00\n")
    with pytest.raises(ValidationFailed) as e:
        load_uploads(spark, paths)
    bad = rows(e.value.report.filter("violations IS NULL OR violations > 0"))
    assert [(r["table"], r["check"], r["column"]) for r in bad] == [("ads_daily", "unexpected_column", "geo")]


def test_csv_quotes_line_breaks_and_missing_cells(spark):
    from mktpulse.plans.marts import load_uploads

    d = tempfile.mkdtemp(prefix="mktpulse-quotes-")
    paths = _growth(d, "")
    paths["ads_daily"] = _write(d, "ads_q", f"{ADS}\n2025-12-01 00:00:00,\"a \"\"b\"\", c\",\"two\nlines\",1000,10,50.0\n"
                                            "2025-12-02,NA,W,5,1,NA\n")
    paths["customers"] = _write(d, "cust", "user_id,first_seen_ts\nU1,2025-11-20 00:00:00\n")
    paths["web_events"] = _write(d, "web4", "user_id,session_id,event_ts,event_name,device,source,medium,campaign\n"
                                            "U1,S1,2025-12-01 09:00:00,page_view,mobile,Meta,paid,W\n")
    got = rows(load_uploads(spark, paths, multi_line=True)["tables"]["ads_daily"], ["impressions"])
    assert [(str(r["dt"]), r["channel"], r["campaign"], r["spend"]) for r in got] == [
        ("2025-12-02", None, "W", None), ("2025-12-01", 'a "b", c', "two\nlines", 50.0)]


def test_ragged_rows_are_reported(spark):
    from mktpulse.plans.marts import ValidationFailed, load_uploads

    d = tempfile.mkdtemp(prefix="mktpulse-ragged-")
    paths = _growth(d, "2025-12-01,Meta,W,1000,10,50.0,Delhi,too many\n2025-12-01,Meta,W,1000,10,50.0,Delhi\n")
    with pytest.raises(ValidationFailed) as e:
        load_uploads(spark, paths, "growth")
    assert [(r["check"], r["violations"]) for r in rows(e.value.report.filter("violations > 0"))] == [("ragged_row", 1)]


@pytest.mark.parametrize("kind,cell,want", [
    ("float", "NaN", None), ("float", "inf", None), ("float", "-Infinity", None), ("float", "1e3", 1000.0), ("float", "x", None),
    ("date", "2024-01-01 00:00:00", "2024-01-01"), ("date", "12:30:00", None), ("date", "2024/01/01", None), ("int", "1.5", 1),
    ("datetime", "12:30:00", None), ("datetime", "2024-01-05", "2024-01-05 00:00:00")])
def test_cells(spark, kind, cell, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(validate._parse(F.lit(cell), kind).alias("v"), validate._bad(F.lit(cell), kind, "strict").alias("bad")).first()
    assert (got.v if kind in ("float", "int") else got.v and str(got.v)) == want
    assert got.bad == (want is None and cell != "NaN")  # NaN is a missing value; infinities do not parse
