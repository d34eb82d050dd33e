"""Column-expression helpers (all JVM-side built-ins, codegen-friendly)."""

from mktpulse.functions.ratios import MONEY, MONEY_SUM, dsum, money, ratio
from mktpulse.functions.dates import month_start, months_between_firsts
from mktpulse.functions.hashing import md5_bucket, md5_fraction

__all__ = [
    "ratio", "money", "dsum", "MONEY", "MONEY_SUM",
    "month_start", "months_between_firsts",
    "md5_bucket", "md5_fraction",
]
