"""Validation jobs (V1-V10) on hand-made raw tables."""

from __future__ import annotations

from conftest import rows
from mktpulse.operators import validate as V

ADS_RAW = "dt string, channel string, campaign string, impressions string, clicks string, spend string"


def _report(df, table, mode="strict", allow_extra=False):
    return {(r["check"], r["column"]): r["violations"] for r in rows(V.check_table(df, table, mode, allow_extra))}


def test_strict_parse(spark):
    ads = spark.createDataFrame([
        ("2025-12-01", "Meta", "W", "120000", "1.5", "4200.0"),   # 1.5 as int truncates: fine
        ("2025/12/01", "Meta", "W", "x", "3200", "abc"),         # bad date, bad int, bad float
        (None, "Meta", "W", None, "1", None),                     # NULL date/float pass, NULL int fails
    ], ADS_RAW)
    r = _report(ads, "ads_daily")
    assert r[("parse_date", "dt")] == 1
    assert r[("parse_int", "impressions")] == 2 and r[("parse_int", "clicks")] == 0
    assert r[("parse_float", "spend")] == 1 and r[("non_empty", None)] == 0
    c = _report(ads, "ads_daily", "coerce")
    assert c[("parse_date", "dt")] == 2 and c[("parse_float", "spend")] == 2


def test_columns_and_domains(spark):
    extra = spark.createDataFrame([("2025-12-01", "M", "W", "1", "1", "1", "Delhi", "x")],
                                  ADS_RAW + ", geo string, note string")
    r = rows(V.check_table(extra, "ads_daily"))
    assert r == [{"table": "ads_daily", "check": "unexpected_column", "column": "note", "violations": None}]
    assert all(x["check"] != "unexpected_column" for x in rows(V.check_table(extra, "ads_daily", allow_extra=True)))
    missing = spark.createDataFrame([("2025-12-01", "M")], "dt string, channel string")
    assert {x["column"] for x in rows(V.check_table(missing, "ads_daily"))} == {
        "campaign", "impressions", "clicks", "spend"}
    web = spark.createDataFrame([
        ("u", "s", "2025-12-01 10:00:00", "page_view", "m", "Meta", "paid", "W"),
        ("u", "s", "2025-12-01 10:00:00", "purchase", "m", "Meta", "paid", "W"),
        ("u", "s", "not a time", None, "m", "Meta", "paid", "W"),
    ], "user_id string, session_id string, event_ts string, event_name string, device string, "
       "source string, medium string, campaign string")
    w = _report(web, "web_events")
    assert w[("domain", "event_name")] == 2 and w[("parse_datetime", "event_ts")] == 1
    assert [x["event_name"] for x in rows(V.unknown_events(web))] == ["nan", "purchase"]
    exp = spark.createDataFrame([("u", "A", "Test", "2025-12-01"), ("u", "A", "holdout", "2025-12-01")],
                                "user_id string, campaign string, group string, exposure_ts string")
    assert _report(exp, "exposure_holdout")[("domain", "group")] == 1


def test_empty_gate_and_quarantine(spark):
    empty = spark.createDataFrame([], ADS_RAW)
    assert _report(empty, "ads_daily")[("non_empty", None)] == 1
    ads = spark.createDataFrame([("2025-12-01", "M", "W", "1", "2", "3.5"), ("bad", "M", "W", "1", "2", "3.5")],
                                ADS_RAW)
    rep = V.validation_report({"ads_daily": ads, "exposure_holdout": None})
    assert rows(V.gate(rep)) == [{"table": "ads_daily", "ok": False, "failed_checks": 1}]
    clean, quarantine = V.split_clean(V.typed(ads, "ads_daily"))
    c = rows(clean)
    assert len(c) == 1 and c[0]["impressions"] == 1 and c[0]["spend"] == 3.5
    assert rows(quarantine)[0]["_errors"] == ["parse_date:dt"]


def test_extra_date_formats(spark):
    ads = spark.createDataFrame([("2025-12-01", "M", "W", "1", "2", "3.5"), ("2025/12/02", "M", "W", "1", "2", "3.5")],
                                ADS_RAW)
    assert _report(ads, "ads_daily")[("parse_date", "dt")] == 1  # ISO only by default (D26)
    r = {(x["check"], x["column"]): x["violations"]
         for x in rows(V.check_table(ads, "ads_daily", date_formats=("yyyy/MM/dd",)))}
    assert r[("parse_date", "dt")] == 0
    clean, _ = V.split_clean(V.typed(ads, "ads_daily", date_formats=("yyyy/MM/dd",)))
    assert sorted(str(x["dt"]) for x in rows(clean)) == ["2025-12-01", "2025-12-02"]


def test_optional_columns_strictness(spark):
    ads = spark.createDataFrame([("2025-12-01", "M", "W", "1", "1", "1", "Delhi", "Test")],
                                ADS_RAW + ", geo string, holdout_group string")
    assert all(r["check"] != "unexpected_column" for r in rows(V.check_table(ads, "ads_daily")))
    strict = rows(V.check_table(ads, "ads_daily", allow_optional=False))
    assert sorted(r["column"] for r in strict) == ["geo", "holdout_group"]
