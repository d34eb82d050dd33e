"""Helpers shared by the corpus operators.

Rules every operator follows: a NULL text is the empty text, documents are
picked by the columns an operator names and any other column is ignored or
carried along untouched, intermediate results that must be computed once go to
the cluster's shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mktpulse.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on the executors and the shared folder known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the cluster's shared folder (not created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once: write it as Parquet to the shared folder and read it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """``(pyarrow filesystem, path)`` of a shared folder; runs in tasks too."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the text, NULL as the empty text."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, order: list, values: list[str] = ()) -> DataFrame:
    """``rows`` with ``_place`` (from 1) in the given total order and, for each of ``values``, ``<value>_before``: its sum over
    the rows before.

    Range partitions, sorted and written once; sums within a partition plus those of the partitions before it (one row each).
    """
    n = partitions(rows.sparkSession)
    placed = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    zero = F.lit(0)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_sum_{v}") for v in values])
               .select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_rows"),
                       *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), zero).alias(f"_off_{v}") for v in values]))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{v}_before": F.coalesce(F.sum(v).over(within), zero) for v in values}
    j = placed.withColumns(sums).join(F.broadcast(offsets), "_part") if values else placed.join(F.broadcast(offsets), "_part")
    return j.select(*rows.columns, (F.col("_rows") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("_place"),
                    *[(F.col(f"{v}_before") + F.col(f"_off_{v}")).alias(f"{v}_before") for v in values])


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type)
         for n, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def list_array(values, lengths, kind) -> pa.ListArray:
    """Arrow list column from flat values and the length of each row."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def lookup_hot(facts: DataFrame, lookup: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """LEFT JOIN of ``facts`` with one ``lookup`` row per key (``key``, ``n``, ...) where ``n`` counts
    the key's fact rows and ``total`` all of them.

    Keys with more than ``total / share`` rows are hot. Their counts sum to at most ``total``, so fewer
    than ``share`` keys are hot: their rows are broadcast. Hot facts are dealt evenly in the shuffle
    join that serves the other keys, so no task gets a hot key's rows. (By a hash of the row, so that a task that
    is run again deals them alike.)
    """
    hot_at = total // share
    cols = [c for c in lookup.columns if c != key]
    hot = lookup.where(F.col("n") > hot_at).select(
        F.col(key), F.struct(*cols).alias("_hot"))
    cold = lookup.where(F.col("n") <= hot_at).select(
        F.col(key).alias("_cold_key"), F.lit(0).alias("_deal"), F.struct(*cols).alias("_cold"))
    tagged = facts.join(F.broadcast(hot), key, "left")
    tagged = tagged.withColumn("_deal", F.when(
        F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*[facts[c] for c in facts.columns]), F.lit(1 << 20))).otherwise(0).cast("int"))
    joined = tagged.join(cold, (F.col(key) == F.col("_cold_key")) & (tagged["_deal"] == cold["_deal"]), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[facts[c] for c in facts.columns], *[found[c].alias(c) for c in cols])
