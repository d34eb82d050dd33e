"""Readers, catalog views.

The reference loads uploaded CSVs with pandas on the driver and copies them
into Spark. Here every input is read by Spark's own distributed readers; the
CSV path reads all columns as strings (no schema inference pass over the data)
and the typed parse is a separate, distributed validation job
(``operators.validate``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mktpulse.session import ensure_utc

MANDATORY = ["ads_daily", "web_events", "orders", "customers"]
OPTIONAL = ["exposure_holdout"]


#: Column that holds the text of a row whose cells do not fit the header.
RAGGED = "_ragged_row"


def read_csv_raw(spark: SparkSession, path: str, multi_line: bool = False, ragged: bool = False) -> DataFrame:
    """Header CSV with every column as string; unknown columns kept.

    No inference pass: columns are matched by header name, so column order in
    the file does not matter and extra columns survive for the V2 check. The
    typed parse is ``operators.validate.typed``. A quote within a quoted cell
    is doubled, as spreadsheets write it.

    ``multi_line``: quoted cells may hold line breaks. Such a file cannot be
    split, so one task reads it: give large uploads as several files.
    ``ragged``: add ``RAGGED`` with the text of rows that have too few or too many cells.
    """
    ensure_utc(spark)
    reader = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line))
    if not ragged:
        return reader.csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*reader.csv(path).columns, RAGGED]])
    # without pruning, a row's cells are counted whatever columns a query reads
    return reader.schema(schema).option("columnNameOfCorruptRecord", RAGGED).option("columnPruning", False).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame | None], mandatory: list[str] | None = None) -> list[str]:
    """Register the mandatory views; an absent optional table is skipped.

    Returns the names registered. A missing mandatory table is an error.
    """
    names = []
    mandatory = MANDATORY if mandatory is None else mandatory
    for name in mandatory:
        if tables.get(name) is None:
            raise ValueError(f"mandatory table {name} is missing")
    for name in dict.fromkeys([*mandatory, *MANDATORY, *OPTIONAL]):
        df = tables.get(name)
        if df is None:
            continue
        df.createOrReplaceTempView(name)
        names.append(name)
    return names


def table(spark: SparkSession, name: str) -> DataFrame | None:
    """Read a registered view back by name; None for an absent optional view."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if name in OPTIONAL:
        return None
    raise ValueError(f"table {name} is not registered")
