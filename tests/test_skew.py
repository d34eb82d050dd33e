"""Skew invariants on test data with a planted hot user.

Every third event of sf0.01 is reassigned to one user (a third of all rows,
the skew case). The user's rows must fall into many small segments, and the
attribution result must not depend on how long the segments are.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from mktpulse.operators import attribution as A
from mktpulse.sources.bindings import orders_from, web_events_from


@pytest.fixture(scope="module")
def skewed(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(999_999)).otherwise(F.col("user_id")))
    return web_events_from(ev), orders_from(ev)


def test_hot_user_is_cut_into_segments(spark, skewed):
    web, od = skewed
    tl = A.timeline(web.select("user_id", "event_ts", "source", "campaign"),
                    od.select("order_id", "user_id", "order_ts", "revenue"))
    n = tl.count()
    sizes = [r["n"] for r in tl.filter(F.col("user_id") == "U999999").groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) > n / 4
    assert max(sizes) <= n / 100


def test_result_independent_of_segments(spark, skewed):
    web, od = skewed
    results = []
    for n in (600, 3600, 30 * 86_400):
        got = A.attribution_models(web, od, segment_seconds=n).collect()
        results.append({(r["channel"], r["campaign"]): r for r in got})
    base = results[0]
    for other in results[1:]:
        assert set(other) == set(base)
        for k, r in base.items():
            o = other[k]
            assert o["orders"] == r["orders"]
            assert o["revenue_last_click"] == r["revenue_last_click"]
            assert o["revenue_first_click"] == r["revenue_first_click"]
            for f in ("revenue_linear", "revenue_time_decay"):
                assert abs(o[f] - r[f]) <= 1e-6 * max(1.0, abs(r[f])), (k, f)
