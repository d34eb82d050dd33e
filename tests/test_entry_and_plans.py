"""Driver contract, oracle agreement at sf0.001, and plan shapes."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as se
from mktpulse.plans.catalogue import QUERIES
from mktpulse.plans.oracle import ORACLE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "ROAS" in df.columns and "CPM" in df.columns


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(se.queries())
    assert set(se.oracle_sql()) <= set(se.queries())


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _canon(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rs),
                                           key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    sdf = se.queries()[key](spark, SF001)
    sc, sr = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    duck.execute(f'CREATE OR REPLACE VIEW "oracle {key}" AS {se.oracle_sql()[key]}')  # a statement that a view can hold
    res = duck.execute(f'SELECT * FROM "oracle {key}"')
    oc, orr = _canon([c[0] for c in res.description], res.fetchall())
    assert sc == oc
    assert sr == orr


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_paid_scan_is_pruned_and_pushed(spark):
    df = se.queries()["paid_perf_daily"](spark, SF001)
    txt = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in txt and "IsNotNull(event_type)" in txt
    # only the columns the mart needs are read from events
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in txt \
        or "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in txt
    assert "props" not in txt.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("key", ["paid_perf_daily", "funnel_stage_daily", "cac_daily", "ltv_by_cohort",
                                 "retention_rates", "incrementality_uplift", "last_touch", "budget_guarded",
                                 "growth_summary", "holdout_detail"])
def test_no_cartesian_products(spark, key):
    p = _plan(se.queries()[key](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cohorts_shuffle_pre_aggregated_rows(spark):
    """LTV: orders are combined per (user, day) map-side before any exchange,
    and the per-user window adds no join."""
    p = _plan(se.queries()["ltv_by_cohort"](spark, SF001))
    assert "Join" not in p
    assert "partial_sum" in p
