"""Safe ratios and exact money sums.

The reference uses three zero-denominator policies (survey D1-D3):

* ``"null"``      -- ratio only when the denominator is > 0, else NULL;
* ``"zero"``      -- same guard, but 0.0 instead of NULL;
* ``"unguarded"`` -- plain division; a zero denominator gives NULL here
  (``try_divide``) where pandas would give inf/NaN. Negative denominators
  still divide.

Ratios are computed in double from double operands, so every engine that
follows IEEE-754 produces the same bits.

Money is summed as ``decimal(28,8)`` (exact and order-independent: eight places
keep what a cent is made of, and sums have 38 digits) and cast to double once,
at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Money of one row; a sum of it is decimal(38,8).
MONEY = "decimal(28,8)"
MONEY_SUM = "decimal(38,8)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den, on_zero: str = "null") -> Column:
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    if on_zero == "null":
        return F.when(d > 0, n / d)
    if on_zero == "zero":
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))
    if on_zero == "unguarded":
        return F.try_divide(n, d)
    raise ValueError(f"unknown zero policy {on_zero!r}")


def money(x) -> Column:
    """Cast to the exact money type used for every revenue/spend/cost sum."""
    return _c(x).cast(MONEY)


def dsum(x) -> Column:
    """Exact sum of a money column, as double."""
    return F.sum(money(x)).cast("double")
