"""Budget allocation (B1-B4) and rounded report tables.

Every global total a row needs (sum of ROAS, channel count, sum of clipped
shares) enters as a scalar subquery: Spark runs the one-row aggregate once
and inlines the value -- no cross join, no single-partition window.
Rounding is half-to-even (``bround``), as pandas rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.contracts import DEFAULT_TOTAL_BUDGET, MAX_SHARE, MIN_SHARE


def budget_weight(channel_kpis: DataFrame) -> DataFrame:
    """B1: ``budget_weight = ROAS / sum(ROAS)`` over the channel KPI table."""
    total = channel_kpis.agg(F.sum("ROAS")).scalar()
    return channel_kpis.withColumn("budget_weight", F.try_divide(F.col("ROAS"), total))


def guarded_allocation(channel_summary: DataFrame, total_budget: float = DEFAULT_TOTAL_BUDGET,
                       min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """B2 + B3: ROAS-weighted shares (equal split when all ROAS are 0),
    clipped to [min_share, max_share], renormalised once -- so a final share
    may leave the bounds again, as in the reference -- then times the budget."""
    if not 0 <= min_share <= max_share:
        raise ValueError("need 0 <= min_share <= max_share")
    # one scalar holds all that a share needs: the ROAS of every channel (a dimension's few values), their sum and
    # count; the clipped sum is folded from the same array, so nothing is derived twice
    t = channel_summary.agg(F.struct(F.sum("ROAS").alias("s"), F.count(F.lit(1)).alias("n"),
                                     F.collect_list("ROAS").alias("all")).alias("t")).scalar()
    t = channel_summary.withColumn("_t", t)

    def clip(roas):
        raw = F.when(F.col("_t.s") == 0, F.lit(1.0) / F.col("_t.n")).otherwise(roas / F.col("_t.s"))
        return F.least(F.greatest(raw, F.lit(min_share)), F.lit(max_share))

    # channels without a ROAS are left out of the list, yet their NULL share is clipped like any other
    missing = (F.col("_t.n") - F.size("_t.all")) * clip(F.lit(None).cast("double"))
    denom = F.aggregate(F.array_sort("_t.all"), F.lit(0.0), lambda a, x: a + clip(x)) + F.coalesce(missing, F.lit(0.0))
    share = clip(F.col("ROAS")) / denom
    return t.withColumns({"rec_share": share, "rec_budget": share * F.lit(float(total_budget))}).drop("_t")


def allocation_table(allocation: DataFrame) -> DataFrame:
    """The allocation table, largest budget first, display rounding."""
    t = allocation.select(
        "channel", "spend", "revenue",
        F.bround("ROAS", 2).alias("ROAS"), F.bround("CAC", 0).alias("CAC"),
        F.bround("CTR", 4).alias("CTR"), F.bround("CVR", 4).alias("CVR"),
        F.bround("rec_share", 4).alias("rec_share"), F.bround("rec_budget", 0).alias("rec_budget"))
    return t.orderBy(F.desc("rec_budget"), F.asc_nulls_last("channel"))


def round_numeric(df: DataFrame, places: int = 2) -> DataFrame:
    """Every numeric column rounded half-to-even to ``places``."""
    num = {"double", "float", "decimal"}
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        out.append(F.bround(F.col(f.name), places).alias(f.name) if kind in num or kind.startswith("decimal")
                   else F.col(f.name))
    return df.select(*out)


def attribution_table(attribution: DataFrame) -> DataFrame:
    """Attribution view, revenue rounded to whole units."""
    return attribution.withColumn("revenue", F.bround("revenue", 0))


def holdout_table(detail: DataFrame) -> DataFrame:
    """Holdout detail, spend and revenue to whole units, ROAS to 2 places."""
    return detail.withColumns({"spend": F.bround("spend", 0), "revenue": F.bround("revenue", 0),
                               "ROAS": F.bround("ROAS", 2)})


def ltv_table(ltv: DataFrame) -> DataFrame:
    """T4: cohort LTV table rounded to whole units, in cohort order."""
    return (ltv.withColumns({"revenue_h": F.bround("revenue_h", 0), "LTV_horizon": F.bround("LTV_horizon", 0)})
               .orderBy(F.asc_nulls_last("cohort_month")))
