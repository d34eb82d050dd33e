"""Portable, reproducible hash buckets.

The reference assigns holdout arms with an unseeded random draw. We replace it
by the first 32 bits of ``md5(key)``: reproducible across runs, executors and
engines (DuckDB computes the same value with
``('0x' || substr(md5(key), 1, 8))::BIGINT``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(x) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(x)."""
    col = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_fraction(x) -> Column:
    """md5 bucket mapped onto [0, 1)."""
    return md5_bucket(x) / F.lit(4294967296.0)
