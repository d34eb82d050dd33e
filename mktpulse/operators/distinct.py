"""Exact distinct counts that can be added up (P3 buyers, U2/U3 sessions, R1 users).

``countDistinct`` per day cannot be summed over days: a buyer of two days counts twice (the buyer-days of D18),
and the exact number over a range needs the facts again. Here a key gets a dense number once (``dictionary``),
the facts become one bitmap per group and 32,768 numbers (``bitmaps``: built map-side by ``bitmap_construct_agg``), and any
coarser level -- a date range, a channel, everything -- is an OR of bitmaps and a count of bits (``distinct_of``). The bitmaps
are a table of their own, to be kept by day beside the marts.

Sizes: the dictionary has a row per key and is never broadcast as a whole; a bitmap takes 4 KB, so they pay off where a group
holds more than some hundred of 32,768 neighbouring keys. Facts of the heaviest keys meet their number by broadcast
(``joins.lookup_join``), all others in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.operators.joins import lookup_join
from mktpulse.session import ensure_checkpoint_dir


def dictionary(facts: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(key, id): a number for every non-NULL key, written once (the numbers must not change afterwards).

    Range partitions number their keys from the partition's own start, so neighbouring keys share bitmaps.
    """
    spark = facts.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = facts.where(F.col(key).isNotNull()).select(key).distinct()
    return (keys.repartitionByRange(n, key).sortWithinPartitions(key)
            .select(key, F.monotonically_increasing_id().alias("id")).checkpoint())


def bitmaps(facts: DataFrame, ids: DataFrame, key: str, by: list) -> DataFrame:
    """by..., bucket, bits: which keys each group of the facts has. NULL keys and keys outside the dictionary do not count."""
    names = [F.col(b) if isinstance(b, str) else b for b in by]
    numbered = lookup_join(facts, ids, key, "inner")
    return (numbered.groupBy(*names, F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))


def distinct_of(maps: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """by..., name: exact distinct keys of each group of a coarser level (``by`` = [] for one row)."""
    merged = maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    count = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias(name)
    return merged.groupBy(*by).agg(count) if by else merged.agg(count)


def buyers_by_campaign(orders: DataFrame) -> DataFrame:
    """channel, campaign, buyers (buyer-days, D18), buyers_distinct (over the whole range), from one set of day bitmaps."""
    ids = dictionary(orders, "user_id")
    days = bitmaps(orders, ids, "user_id", [F.to_date("order_ts").alias("dt"), "channel", "campaign"])
    # both levels in one pass: bits of the days summed, bits of their OR
    merged = days.groupBy("channel", "campaign", "bucket").agg(
        F.sum(F.bitmap_count("bits")).alias("days"), F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("channel", "campaign").agg(
        F.sum("days").alias("buyers"), F.sum(F.bitmap_count("bits")).alias("buyers_distinct"))


def sessions_by_stage(web: DataFrame) -> DataFrame:
    """funnel_stage, sessions_distinct over the whole range, from bitmaps by day and stage."""
    from mktpulse.operators.funnel import with_stage

    w = with_stage(web)
    days = bitmaps(w, dictionary(w, "session_id"), "session_id", [F.to_date("event_ts").alias("dt"), "funnel_stage"])
    return distinct_of(days, ["funnel_stage"], "sessions_distinct")
