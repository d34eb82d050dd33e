"""Mart pipeline and dashboard compositions.

``build_marts`` is the Spark dashboard's DAG: seven marts from five tables,
the incrementality mart only when exposures are given (S6). ``write_marts``
writes each mart once -- daily marts partitioned by ``dt`` so readers prune
days -- and ``previews`` reads the written marts back with the dashboard's
ordering and limits (S7), instead of recomputing every mart a second time.

The other three dashboards are compositions of the same operators:
``growth_dashboard`` (filters, KPI cards, budget, funnel, performance,
growth), ``channel_dashboard`` (channel KPIs, budget weight, coarse funnel,
90-day retention) and ``campaign_file_dashboard`` (validated campaign file).
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mktpulse.contracts import (DASHBOARDS, DEFAULT_EXPOSURE_LOOKBACK_DAYS, DEFAULT_LTV_LOOKBACK_DAYS, DEFAULT_TOP_N,
                                DEFAULT_TOTAL_BUDGET)
from mktpulse.operators import attribution, budget, filters, funnel, growth, incrementality, paid, validate
from mktpulse.session import ensure_checkpoint_dir, materialize_small
from mktpulse.sources.readers import read_csv_raw, register_views

PARTITION_BY = {
    "mart_paid_perf_daily": ["dt"],
    "mart_funnel_stage_daily": ["dt"],
    "mart_cac_daily": ["dt"],
}
# (order columns, descending?, limit) of each preview; None = no limit.
PREVIEW = {
    "mart_paid_perf_daily": (["dt"], True, 50),
    "mart_funnel_stage_daily": (["dt"], True, 50),
    "mart_cac_daily": (["dt"], True, 50),
    "mart_attribution_summary": (["revenue_last_click"], True, 50),
    "mart_ltv_cohort": (["cohort_month"], True, 50),
    "mart_retention_cohort": (["cohort_month", "months_since_cohort"], False, 100),
    "mart_incrementality_uplift": (["incremental_revenue"], True, None),
}


@dataclass
class MartParams:
    start: str
    end: str
    ltv_lookback_days: int = DEFAULT_LTV_LOOKBACK_DAYS
    exposure_lookback_days: int = DEFAULT_EXPOSURE_LOOKBACK_DAYS

    def __post_init__(self):
        if not 30 <= self.ltv_lookback_days <= 365:
            raise ValueError("LTV lookback must be within 30..365 days")


def build_marts(ads: DataFrame, web: DataFrame, orders: DataFrame, customers: DataFrame | None,
                exposure: DataFrame | None, p: MartParams, share: bool = False) -> dict[str, DataFrame]:
    """The seven marts, lazily. ``customers`` is carried for validation only: no mart reads it.

    ``share`` writes the roll-up of all orders to (user, day) once, to the checkpoint folder, and the three marts over
    all orders (CAC, LTV, retention) start from it: one scan and one shuffle of the orders in place of three.
    """
    days = None
    if share:
        ensure_checkpoint_dir(orders.sparkSession)
        days = growth.user_days(orders).checkpoint()
    ad = filters.date_range(ads, "dt", p.start, p.end, add_dt=None)
    we = filters.date_range(web, "event_ts", p.start, p.end, add_dt=None)
    od = filters.date_range(orders, "order_ts", p.start, p.end, add_dt=None)
    marts = {
        "mart_paid_perf_daily": paid.paid_perf_daily(ad, od),
        "mart_funnel_stage_daily": funnel.funnel_stage_daily(we),
        "mart_cac_daily": growth.cac_daily(ad, orders, p.start, p.end, days),
        "mart_ltv_cohort": growth.ltv_by_cohort(orders, p.ltv_lookback_days, days=days),
        "mart_retention_cohort": growth.retention_rates(orders, days=days),
        "mart_attribution_summary": attribution.attribution_models(we, od),
    }
    if exposure is not None:
        marts["mart_incrementality_uplift"] = incrementality.incrementality_uplift(
            exposure, od, p.exposure_lookback_days)
    return marts


def write_marts(marts: dict[str, DataFrame | None], path: str | None = None, fmt: str = "parquet",
                as_tables: bool = False, files_per_day: int = 1, days: tuple[str, str] | None = None) -> list[str]:
    """Overwrite each mart once. Daily marts are clustered by ``dt`` and
    ``files_per_day`` hash buckets before the partitioned write: a day lands
    in so many files, written by as many tasks.

    ``days`` = (first, last) replaces these days of the daily marts and touches nothing else: partitions of other days
    keep their files, a day that has no rows any more goes, marts without days are left alone. A rerun
    gives the same rows. Needs a ``path``.
    """
    if days is not None:
        if as_tables or path is None:
            raise ValueError("days needs a path")
        return [name for name, df in marts.items() if df is not None and PARTITION_BY.get(name)
                and _replace_days(df, os.path.join(path, name), fmt, files_per_day, *days)]
    written = []
    for name, df in marts.items():
        if df is None:
            continue
        parts = PARTITION_BY.get(name, [])
        if parts:
            df = _by_day(df, files_per_day)
        w = df.write.mode("overwrite").format(fmt)
        if parts:
            w = w.partitionBy(*parts)
        if as_tables:
            w.saveAsTable(name)
        else:
            if path is None:
                raise ValueError("path is required unless as_tables=True")
            w.save(os.path.join(path, name))
        written.append(name)
    return written


def _by_day(df: DataFrame, files_per_day: int) -> DataFrame:
    if files_per_day == 1:
        return df.repartition("dt")
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day)))
    # a stated number of partitions: small days are not merged into one task again
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "dt", "_bucket").drop("_bucket")


def _replace_days(df: DataFrame, folder: str, fmt: str, files_per_day: int, first: str, last: str) -> bool:
    """Dynamic partition overwrite of the days from first to last; days without rows are removed afterwards."""
    met = Observation()  # the days written, known from the write itself
    df = filters.date_range(df, "dt", first, last, add_dt=None).observe(met, F.collect_set(F.col("dt").cast("string")).alias("days"))
    (_by_day(df, files_per_day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").format(fmt).save(folder))
    day, end, written = date.fromisoformat(first), date.fromisoformat(last), set(met.get["days"] or [])
    spark = df.sparkSession
    while day <= end:  # calendar days of the range
        if day.isoformat() not in written:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/dt={day.isoformat()}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        day += timedelta(days=1)
    return True


def read_mart(spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    return spark.table(name) if path is None else spark.read.format(fmt).load(os.path.join(path, name))


def previews(spark: SparkSession, names, path: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The dashboard previews over the *written* marts."""
    out = {}
    for name in names:
        cols, desc, limit = PREVIEW[name]
        df = read_mart(spark, name, path, fmt)
        df = df.orderBy(*[F.desc(c) if desc else F.asc(c) for c in cols])
        out[name] = df.limit(limit) if limit else df
    return out


class ValidationFailed(ValueError):
    """A mandatory upload failed its contract; ``report`` has the details."""

    def __init__(self, failed: list[str], report: DataFrame):
        super().__init__(f"validation failed for: {', '.join(failed)}")
        self.failed, self.report = failed, report


def load_uploads(spark: SparkSession, paths: dict[str, str], dashboard: str = "main", mode: str | None = None,
                 date_formats: tuple[str, ...] = (), multi_line: bool = False) -> dict:
    """S1 + V10 + S3/S6: read every uploaded CSV once, write its typed rows, clean ones and quarantine apart, and
    take the counts of the checks from that same write; register the clean tables as views.

    ``dashboard``: ``"main"`` (four mandatory tables, strict parse, no other
    columns), ``"growth"`` (three tables, coerce-then-reject, other columns
    kept) or ``"campaign"`` (the campaign file). As in the reference, any
    failing mandatory table stops the run (raises ``ValidationFailed``
    carrying the full report); an optional table that fails (the exposure
    file) is skipped and the rest proceed. Returns ``{"report", "tables",
    "skipped", "quarantine"}``. Only the counts (one per check) reach the
    driver; the rows go to the shared folder, as Parquet.
    """
    d = DASHBOARDS[dashboard]
    mode = mode or d.mode
    known = [t for t in (*d.mandatory, *d.optional) if t in paths]
    raw = {name: read_csv_raw(spark, paths[name], multi_line, ragged=True) for name in known}
    if not raw:
        raise ValueError(f"none of the tables of the {dashboard} dashboard is given")
    rows, stored = [], {}
    for name, df in raw.items():
        faults = validate.column_faults(df, name, d.allow_extra, d.allow_optional, dashboard)
        if not faults:
            stored[name], faults = _store_checked(df, name, mode, date_formats, dashboard)
        rows += faults
    report = spark.createDataFrame(rows, validate.REPORT_SCHEMA)
    bad = {table for table, _, _, n in rows if n is None or n > 0}
    failed = [t for t in d.mandatory if t not in raw or t in bad]
    if failed:
        raise ValidationFailed(failed, report)
    skipped = [t for t in d.optional if t in bad]
    kept = {t: df for t, df in stored.items() if t not in skipped}
    tables = {t: df.where("_clean").drop("_clean", "_errors") for t, df in kept.items()}
    if dashboard == "campaign":
        tables["campaign_daily"].createOrReplaceTempView("campaign_daily")
    else:
        register_views(spark, {**{t: None for t in d.optional}, **tables}, list(d.mandatory))
    return {"report": report, "tables": tables, "skipped": skipped,
            "quarantine": {t: df.where("NOT _clean").drop("_clean") for t, df in stored.items()}}


def _store_checked(df: DataFrame, name: str, mode: str, date_formats: tuple[str, ...], dashboard: str) -> tuple[DataFrame, list[tuple]]:
    """One pass over an upload: its typed rows as Parquet by ``_clean``, and the report rows observed while writing."""
    spark = df.sparkSession
    typed = validate.typed(df, name, mode, date_formats, dashboard)
    seen = Observation()
    typed = typed.observe(seen, *validate.check_counts(df, name, mode, date_formats, dashboard)).withColumn("_clean", F.size("_errors") == 0)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/upload-{name}-{uuid.uuid4().hex}"
    typed.write.partitionBy("_clean").parquet(folder)
    return spark.read.schema(typed.schema).parquet(folder), validate.report_of(seen.get, df, name, mode, date_formats, dashboard)


class NoRows(ValueError):
    """The filters leave a fact table empty."""


def require_rows(**frames: DataFrame) -> None:
    """V8 after filters: stop when any of the named frames is empty."""
    empty = [name for name, df in frames.items() if df.isEmpty()]
    if empty:
        raise NoRows(f"no rows after filters: {', '.join(empty)}")


# ------------------------------------------------------------------ other dashboards
@dataclass
class GrowthParams:
    start: str
    end: str
    channels: list[str] | None = None
    campaigns: list[str] | None = None
    attribution_model: str = "last_touch"
    total_budget: float = DEFAULT_TOTAL_BUDGET
    top_n: int = DEFAULT_TOP_N
    horizon_days: int = 180

    def __post_init__(self):
        if not 5 <= self.top_n <= 30:
            raise ValueError("top_n must be within 5..30")
        if self.total_budget < 0:
            raise ValueError("total_budget must be >= 0")


def growth_dashboard(ads: DataFrame, orders: DataFrame, web: DataFrame, p: GrowthParams) -> dict[str, DataFrame]:
    """The growth dashboard's frames. The daily paid table feeds five views: they are the levels of one
    roll-up, computed once (its rows are bounded by the calendar, the channels and the campaigns).
    Filters that leave no ads or no orders stop the dashboard (``NoRows``)."""
    a, o, w = filters.apply_dashboard_filters(ads, orders, web, p.start, p.end, p.channels, p.campaigns)
    require_rows(ads_daily=a, orders=o)
    lattice = materialize_small(paid.paid_lattice(paid.paid_daily_exact(a, o)))
    ch = paid.lattice_view(lattice, "channel")
    cac = growth.cac_daily_range(a, o)
    ltv = growth.ltv_horizon(o, p.horizon_days)
    detail = incrementality.holdout_detail(a, o)
    return {
        "kpi_cards": paid.lattice_view(lattice, "total"),
        "channel_summary": ch,
        "allocation": budget.allocation_table(budget.guarded_allocation(ch, p.total_budget)),
        "funnel_table": funnel.funnel_table(w),
        "funnel_long": funnel.funnel_long_of(materialize_small(funnel.funnel_by_campaign(w))),
        "daily_trend": paid.lattice_view(lattice, "day"),
        "top_campaigns": paid.top_of(paid.lattice_view(lattice, "campaign"), p.top_n),
        "attribution": budget.attribution_table(attribution.attribution(w, o, p.attribution_model)),
        "holdout_detail": budget.holdout_table(detail),
        "holdout_summary": incrementality.holdout_summary(a, o),
        "cac_daily": cac,
        "ltv_table": budget.ltv_table(ltv),
        "retention_matrix": growth.retention_matrix(materialize_small(growth.retention_rates(o, sort=False))),
        "growth_summary": growth.growth_summary(ltv, cac),
        "filter_options": filters.filter_options(ads, orders, web),
        "date_bounds": filters.date_bounds(ads, orders, web),
        "unknown_events": validate.unknown_events(web),
    }


def channel_dashboard(ads: DataFrame, orders: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    a = filters.date_range(ads, "dt", start, end, add_dt=None)
    o = filters.date_range(orders, "order_ts", start, end, add_dt=None)
    k = materialize_small(paid.channel_kpi(a, o))
    return {
        "kpi_cards": paid.kpi_cards_channel(k),
        "channel_table": budget.round_numeric(budget.budget_weight(k), 2),
        "funnel": funnel.funnel_coarse(k),
        "retention_90d": growth.retention_90d(o),
    }


def campaign_file_dashboard(campaign_file_raw: DataFrame, quarantine: bool = False) -> dict[str, DataFrame]:
    """Validate (missing columns, empty file, bad dates, non-numeric values),
    then KPIs. Any violation stops, as in the reference; ``quarantine=True``
    sets bad rows aside instead and reports on the others."""
    report = validate.check_table(campaign_file_raw, "campaign_daily", mode="numeric", allow_extra=True)
    bad = [r["check"] for r in report.collect() if r["violations"] is None or r["violations"]]  # a row per check
    if bad and (not quarantine or any(c in ("missing_column", "non_empty") for c in bad)):
        raise ValidationFailed(["campaign_daily"], report)
    clean, aside = validate.split_clean(validate.typed(campaign_file_raw, "campaign_daily", "numeric"))
    return {
        "report": report,
        "quarantine": aside,
        "ranking": paid.campaign_ranking(clean),
        "cards": paid.campaign_cards(clean),
    }


def main(argv=None) -> None:
    """``python -m mktpulse.plans.marts --sf DIR --out DIR``: build the marts
    from the test-data bindings, write them, print the previews' row counts."""
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", required=True)
    ap.add_argument("--start", default="2024-01-01")
    ap.add_argument("--end", default="2024-01-31")
    args = ap.parse_args(argv)
    from mktpulse.session import build_session
    from mktpulse.sources.bindings import Binding

    spark = build_session()
    b = Binding(spark, args.sf)
    marts = build_marts(b.ads(), b.web(), b.orders(), b.customers(), b.exposure(), MartParams(args.start, args.end), share=True)
    names = write_marts(marts, args.out)
    for name, df in previews(spark, names, args.out).items():
        print(name, df.count(), file=sys.stdout)
    spark.stop()


if __name__ == "__main__":
    main()
