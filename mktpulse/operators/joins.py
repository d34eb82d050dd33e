"""Skew-safe join of a fact table to a per-key lookup table.

A sort-merge join sends every fact row of one key to one task; when a key
holds a large share of the facts (a bot user, a default id) that task holds
it. AQE's skew-join split does not help when the lookup side reaches the
join through an aggregate (no shuffle stage directly below the join), which
is the usual shape of a per-key lookup ("the user's last touch").

``lookup_join`` takes the heavy hitters out of the shuffle, in one lazy plan:

1. the ``hot`` keys with the most fact rows, found by one aggregate with a
   map-side combine and a top-k: at most ``hot`` rows, whatever the data, and
   no other key holds more than ``1 / hot`` of the facts;
2. their lookup rows (present or not) are broadcast and joined to the facts;
3. the facts of these keys are then dealt over all tasks by a hash of the row
   instead of by key, match nothing in the ordinary shuffle join that serves
   all other keys, and keep what the broadcast gave them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT = 1000


def hot_keys(facts: DataFrame, key: str, hot: int = DEFAULT_HOT) -> DataFrame:
    """The ``hot`` keys with the most fact rows. NULL keys never join and are never hot."""
    return (facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            .orderBy(F.desc("_rows"), key).limit(hot).select(key))


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot: int = DEFAULT_HOT) -> DataFrame:
    """``facts JOIN lookup USING (key)`` (``how`` = "left" or "inner"); the
    lookup must hold at most one row per key."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    values = [c for c in lookup.columns if c != key]
    found = lookup.select(F.col(key), F.struct(F.lit(True).alias("_is"), *values).alias("_found"))
    top = hot_keys(facts, key, hot).join(found, key, "left").select(key, F.struct("_found").alias("_hot"))
    tagged = facts.join(F.broadcast(top), key, "left")
    # 0 for keys that the shuffle join serves; any other number has no partner there
    deal = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*[facts[c] for c in facts.columns]), F.lit(1 << 20)))
    cold = found.select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("_none"), F.col("_found").alias("_cold"))
    tagged = tagged.withColumn("_deal", deal.cast("bigint"))
    j = tagged.join(cold, (F.col(key) == F.col("_key")) & (F.col("_deal") == F.col("_none")), "left")
    got = F.coalesce(F.col("_hot._found"), F.col("_cold"))
    if how == "inner":
        j = j.filter(got.isNotNull())
    # USING: the key first, once
    return j.select(F.col(key), *[facts[c] for c in facts.columns if c != key], *[got[c].alias(c) for c in values])
