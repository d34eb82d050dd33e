"""Input validation as distributed data-quality jobs.

The reference validates uploaded CSVs with pandas on one machine and stops at
the first failing table. Here a table is checked in one scan: every row-level
check is a ``count_if`` inside a single aggregate, and the per-table results
are unpivoted into one report ``(table, check, column, violations)``. Column
presence (V1, V2) is metadata and costs no scan. ``typed`` parses the raw
strings with ``try_cast`` and tags each row with the checks it fails, so a
caller can split clean rows from a quarantine instead of rejecting the file.

Parse modes:

* ``"strict"`` (main dashboard, V3): NULL dates, timestamps and floats pass;
  a value that does not parse fails; integers go through double and truncate
  (``1.5`` -> 1), and a NULL integer fails.
* ``"coerce"`` (growth dashboard, V4): unparseable -> NULL, then any NULL in a
  typed column fails.
* ``"numeric"`` (campaign file, V9): numeric columns must parse as numbers;
  NULLs pass; the date column is coerce-then-reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktpulse.contracts import FUNNEL_STAGES, HOLDOUT_GROUPS, NA_TOKENS, OPTIONAL_COLUMNS, parsed_columns, schema_of
from mktpulse.sources.readers import RAGGED

REPORT_COLUMNS = ["table", "check", "column", "violations"]
REPORT_SCHEMA = "table string, check string, column string, violations bigint"


def _cell(col: Column) -> Column:
    """The cell's text, NULL for the tokens that mean a missing value."""
    return F.when(~F.trim(col.cast("string")).isin(NA_TOKENS), col)


def _finite(col: Column) -> Column:
    x = col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _parse(col: Column, kind: str, formats: tuple[str, ...] = ()) -> Column:
    """Typed value or NULL. Dates and timestamps are ISO by default (D26), a date may have a time part;
    ``formats`` adds datetime patterns tried in order, e.g. ``("yyyy/MM/dd",)``. NaN and infinities are no numbers."""
    col = _cell(col)
    extra = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    if kind in ("date", "datetime"):
        # the cast alone would take a bare time for today's
        iso = F.when(col.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), col.try_cast("timestamp"))
        at = F.coalesce(iso, *extra) if extra else iso
        return F.to_date(at) if kind == "date" else at
    if kind == "int":
        return _finite(col).try_cast("bigint")
    if kind == "float":
        return _finite(col)
    return col


def _bad(col: Column, kind: str, mode: str, formats: tuple[str, ...] = ()) -> Column:
    parsed = _parse(col, kind, formats)
    if mode == "coerce" or (mode == "strict" and kind == "int"):
        return parsed.isNull()
    if mode == "numeric" and kind == "date":
        return parsed.isNull()
    return _cell(col).isNotNull() & parsed.isNull()


def missing_columns(df: DataFrame, table: str, dashboard: str | None = None) -> list[str]:
    """V1."""
    return [c for c in schema_of(table, dashboard).names if c not in df.columns]


def unexpected_columns(df: DataFrame, table: str, allow_optional: bool = True, dashboard: str | None = None) -> list[str]:
    """V2: columns outside the contract. The growth dashboard expects the
    optional columns (``geo``, ``holdout_group``); the main dashboard's
    stricter check (``allow_optional=False``) rejects them too."""
    ok = [*schema_of(table, dashboard).names, RAGGED, *(OPTIONAL_COLUMNS.get(table, []) if allow_optional else [])]
    return [x for x in df.columns if x not in ok]


def row_checks(table: str, mode: str = "strict", date_formats: tuple[str, ...] = (), dashboard: str | None = None,
               ragged: bool = False) -> list[tuple[str, str, Column]]:
    """(check, column, predicate-of-a-bad-row) for every row-level check. ``ragged``: the reader tells rows with
    too few or too many cells apart."""
    types = parsed_columns(table, dashboard)
    checks = [(f"parse_{t}", c, _bad(F.col(c), t, mode, date_formats)) for c, t in types.items()
              if mode != "numeric" or t in ("date", "int", "float")]
    if table == "web_events" and mode == "strict":
        name = F.col("event_name")
        checks.append(("domain", "event_name", name.isNull() | ~name.isin(FUNNEL_STAGES)))
    if table == "exposure_holdout":
        g = F.lower(F.col("group"))
        checks.append(("domain", "group", g.isNull() | ~g.isin(HOLDOUT_GROUPS)))
    if ragged:
        checks.append(("ragged_row", None, F.col(RAGGED).isNotNull()))
    return checks


def column_faults(df: DataFrame, table: str, allow_extra: bool = False, allow_optional: bool = True,
                  dashboard: str | None = None) -> list[tuple]:
    """V1 + V2 as report rows; needs no scan."""
    meta = [(table, "missing_column", c, None) for c in missing_columns(df, table, dashboard)]
    if not allow_extra:
        meta += [(table, "unexpected_column", c, None) for c in unexpected_columns(df, table, allow_optional, dashboard)]
    return meta


def check_counts(df: DataFrame, table: str, mode: str = "strict", date_formats: tuple[str, ...] = (),
                 dashboard: str | None = None) -> list[Column]:
    """Aggregates over ``typed(df)``, one per row check and the number of rows: for ``DataFrame.observe``, so that
    the counts come from the job that writes the rows."""
    checks = row_checks(table, mode, date_formats, dashboard, RAGGED in df.columns)
    return [*[F.count_if(F.array_contains("_errors", _label(chk, col))).alias(f"c{i}") for i, (chk, col, _) in enumerate(checks)],
            F.count(F.lit(1)).alias("rows")]


def report_of(counts: dict, df: DataFrame, table: str, mode: str = "strict", date_formats: tuple[str, ...] = (),
              dashboard: str | None = None) -> list[tuple]:
    """The report rows of ``check_table`` from the values of ``check_counts``."""
    checks = row_checks(table, mode, date_formats, dashboard, RAGGED in df.columns)
    return [*[(table, chk, col, counts[f"c{i}"]) for i, (chk, col, _) in enumerate(checks)],
            (table, "non_empty", None, int(counts["rows"] == 0))]


def _label(check: str, column: str | None) -> str:
    return f"{check}:{column}" if column else check


def check_table(df: DataFrame, table: str, mode: str = "strict", allow_extra: bool = False,
                date_formats: tuple[str, ...] = (), allow_optional: bool = True, dashboard: str | None = None) -> DataFrame:
    """V1-V9 for one table: one report row per check, in one scan."""
    spark = df.sparkSession
    meta = column_faults(df, table, allow_extra, allow_optional, dashboard)
    if meta:
        # the reference stops at the column checks; so do we
        return spark.createDataFrame(meta, REPORT_SCHEMA)
    checks = row_checks(table, mode, date_formats, dashboard, RAGGED in df.columns)
    aggs = [F.count_if(p).alias(f"c{i}") for i, (_, _, p) in enumerate(checks)]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    s = df.agg(*aggs)
    cols = [F.struct(F.lit(chk).alias("check"), F.lit(col).cast("string").alias("column"), F.col(f"c{i}").alias("violations"))
            for i, (chk, col, _) in enumerate(checks)]
    # V8: an empty table is a violation of its own
    cols.append(F.struct(F.lit("non_empty").alias("check"), F.lit(None).cast("string").alias("column"),
                         F.when(F.col("rows") == 0, 1).otherwise(0).cast("bigint").alias("violations")))
    return (s.select(F.explode(F.array(*cols)).alias("r"))
             .select(F.lit(table).alias("table"), "r.check", "r.column", F.col("r.violations").cast("bigint").alias("violations")))


def validation_report(tables: dict[str, DataFrame | None], mode: str = "strict",
                      allow_extra: bool = False, date_formats: tuple[str, ...] = (), allow_optional: bool = True,
                      dashboard: str | None = None) -> DataFrame:
    """Every table's checks in one report; absent tables are skipped."""
    parts = [check_table(df, name, mode, allow_extra, date_formats, allow_optional, dashboard) for name, df in tables.items()
             if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate(report: DataFrame) -> DataFrame:
    """One row per table, ``ok`` when it has no violation at all."""
    bad = F.col("violations").isNull() | (F.col("violations") > 0)
    return report.groupBy("table").agg((F.count_if(bad) == 0).alias("ok"),
                                       F.count_if(bad).alias("failed_checks"))


def unknown_events(web: DataFrame) -> DataFrame:
    """V6: sorted distinct event names outside the funnel taxonomy (a warning;
    those rows are simply ignored by the funnel)."""
    name = F.coalesce(F.col("event_name").cast("string"), F.lit("nan"))
    return (web.select(name.alias("event_name")).filter(~F.col("event_name").isin(FUNNEL_STAGES))
            .distinct().orderBy("event_name"))


def typed(df: DataFrame, table: str, mode: str = "strict", date_formats: tuple[str, ...] = (),
          dashboard: str | None = None) -> DataFrame:
    """Parse the contract columns and add ``_errors``: the checks a row fails. Text cells that mean a missing
    value become NULL."""
    checks = row_checks(table, mode, date_formats, dashboard, RAGGED in df.columns)
    errs = F.filter(F.array(*[F.when(p, F.lit(_label(chk, col))) for chk, col, p in checks]),
                    lambda x: x.isNotNull())
    kinds = parsed_columns(table, dashboard)
    text = [c for c in schema_of(table, dashboard).names if c not in kinds]
    return df.withColumn("_errors", errs).withColumns(
        {**{c: _parse(F.col(c), t, date_formats) for c, t in kinds.items()}, **{c: _cell(F.col(c)) for c in text}}).drop(RAGGED)


def split_clean(typed_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows (no failed check) and the quarantine, both lazy."""
    ok = F.size("_errors") == 0
    return typed_df.filter(ok).drop("_errors"), typed_df.filter(~ok)
