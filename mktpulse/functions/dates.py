"""Date helpers. All assume the session time zone is UTC (see session.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(x) -> Column:
    """First day of the month of a date/timestamp, as a date."""
    return F.trunc(F.to_date(_c(x)), "month")


def months_between_firsts(later, earlier) -> Column:
    """Whole months between two first-of-month dates (integral by construction)."""
    return F.months_between(_c(later), _c(earlier)).cast("int")
