"""The test-data bindings reproduce the counts recorded in FIXTURES.md."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from mktpulse.operators import growth, incrementality, paid
from mktpulse.sources.bindings import Binding

# (sf dir, paid groups, customers, campaign-file rows, retention pairs, LTV cohorts)
EXPECTED = [(SF001, 265, 15, 81, 786, 26), (SF01, 360, 150, 90, 1845, 51)]


@pytest.mark.parametrize("sf,paid_groups,customers,campaign_rows,ret_pairs,ltv_rows", EXPECTED)
def test_fixture_counts(spark, sf, paid_groups, customers, campaign_rows, ret_pairs, ltv_rows):
    b = Binding(spark, sf)
    assert paid.paid_rollup(b.ads()).count() == paid_groups
    assert b.customers().count() == customers
    assert b.campaign_daily().count() == campaign_rows
    assert growth.retention_rates(b.cohort_orders()).count() == ret_pairs
    assert growth.ltv_by_cohort(b.cohort_orders(), 180).count() == ltv_rows
    arms = incrementality.arm_rollup(incrementality.exposed_users(b.exposure(), b.orders()))
    assert arms.count() == 6
    assert b.web().groupBy("event_name", "source", "campaign").count().count() == 48
    assert b.orders().groupBy("channel", "campaign").count().count() == 12
    assert {r[0] for r in b.ads().select("holdout_group").distinct().collect()} == {"Test", "Control"}
    assert b.orders().filter(F.col("user_id").isNull()).count() == 0
