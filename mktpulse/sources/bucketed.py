"""S4 over tables bucketed by user: joins, windows and per-user aggregates without an exchange.

The per-user operators (C1, L1-L3, R1-R5, A1-A6, I1-I4) all shuffle by ``user_id``. Written once into buckets of ``user_id``,
sorted within them, the tables arrive dealt: Spark reads a bucket per task, and what groups or joins by
``user_id`` starts from there. A user with a large share of all rows makes its bucket large; such tables are better left unbucketed
(the operators split such users themselves).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "user_id", sort_by: str | None = None,
                   files_per_bucket: int = 1) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` buckets and return it as read back.

    Rows are dealt by bucket before the write, so a bucket is ``files_per_bucket`` files and not one per task.
    """
    if files_per_bucket > 1:
        dealt = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(files_per_bucket)))
        dealt = dealt.repartition(buckets * files_per_bucket, key, "_part").drop("_part")
    else:
        dealt = df.repartition(buckets, key)
    w = dealt.write.mode("overwrite").bucketBy(buckets, key)
    w.sortBy(key, *([sort_by] if sort_by else [])).saveAsTable(table)
    return df.sparkSession.table(table)


def is_bucketed(spark: SparkSession, table: str, key: str = "user_id") -> bool:
    """Whether a table is bucketed by ``key`` alone."""
    rows = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return rows.get("Bucket Columns") == f"[`{key}`]"
