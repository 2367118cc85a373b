"""Rounding and money expressions.

Two rounding styles exist in the source application and both are kept:

* cleaning rounds like numpy: scale by 100, round half to even on the binary
  double, scale back (``rint``);
* mart SQL rounds like ``ROUND(x, 2)``: half away from zero on ``x*100``.

Marts aggregate exact integer cents (``bigint``) so sums and means do not
depend on partitioning or summation order; a mean is one division of an exact
cent total by a count, rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round2_even(x) -> Column:
    """numpy-style 2-decimal rounding (2.665 -> 2.66, 1.015 -> 1.01)."""
    return F.rint(_c(x) * F.lit(100.0)) / F.lit(100.0)


def round_half_up(x, digits: int = 2) -> Column:
    """SQL ``ROUND(x, digits)``: scale in double, round half away from zero."""
    scale = float(10 ** digits)
    return F.round(_c(x) * F.lit(scale)) / F.lit(scale)


def to_cents(x) -> Column:
    """Exact integer cents of an amount that already has 2 decimals."""
    return F.round(_c(x) * F.lit(100.0)).cast("bigint")


def to_micros(x) -> Column:
    """Exact integer millionths of an amount that has at most 6 decimals."""
    return F.round(_c(x) * F.lit(1e6)).cast("bigint")


def micros_to_usd(micros) -> Column:
    """``ROUND(SUM(x), 2)`` from an exact total in millionths."""
    return F.round(_c(micros).cast("double") / F.lit(1e4)) / F.lit(100.0)


def cents_to_usd(cents) -> Column:
    """Cent total back to a 2-decimal double (null stays null)."""
    return _c(cents).cast("double") / F.lit(100.0)


def mean_cents_to_usd(cents_sum, count) -> Column:
    """ROUND(AVG(x), 2) from an exact cent sum and a non-null count."""
    return F.round(F.try_divide(_c(cents_sum).cast("double"), _c(count).cast("double"))) / F.lit(100.0)


def pct_1dp(part, total) -> Column:
    """ROUND(100 * part / total, 1); null when total is 0 or null."""
    share = F.try_divide(_c(part).cast("double") * F.lit(100.0), _c(total).cast("double"))
    return F.round(share * F.lit(10.0)) / F.lit(10.0)
