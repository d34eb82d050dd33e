"""Skew-safe lookup join: same rows as a plain join; the heaviest keys are broadcast, and only those."""

from __future__ import annotations

import pytest

from conftest import rows
from mktpulse.operators.joins import hot_keys, lookup_join


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def _facts(spark):
    rs = [("hot", i, float(i)) for i in range(400)] + [(f"k{i % 37}", i, 1.0) for i in range(300)]
    rs += [(None, 1, 1.0), ("nolookup", 2, 2.0)] + [("hot without lookup", i, 3.0) for i in range(200)]
    return spark.createDataFrame(rs, "k string, id int, v double")


@pytest.mark.parametrize("hot", [1, 2, 3, 1000])
def test_lookup_join_matches_plain_join(spark, hot):
    facts = _facts(spark)
    lookup = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"L{i}") for i in range(37)] + [("k99", None)],
                                   "k string, label string")
    for how in ("left", "inner"):
        got = _sorted(lookup_join(facts, lookup, "k", how, hot).select("k", "id", "v", "label"))
        exp = _sorted(facts.join(lookup, "k", how).select("k", "id", "v", "label"))
        assert got == exp, how


def test_hot_keys_are_the_heaviest_and_bounded(spark):
    facts = _facts(spark)
    assert [r["k"] for r in rows(hot_keys(facts, "k", 2))] == ["hot", "hot without lookup"]
    assert hot_keys(facts, "k", 5).count() == 5


def test_hot_facts_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    facts = spark.range(40_000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.max("id").alias("m"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        j = lookup_join(facts, lookup, "k", "left", 10)
        sizes = [r["n"] for r in j.filter("k = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 26_667 and max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) >= 4
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_nothing_runs_before_an_action(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup-join-lazy", "lazy")
    lookup_join(_facts(spark), spark.createDataFrame([("hot", "H")], "k string, label string"), "k")
    assert list(tracker.getJobIdsForGroup("lookup-join-lazy")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
