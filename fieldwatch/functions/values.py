"""Missing values, bounds and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the missing mark of magnetometer residuals.
MISSING_MARK = 99999.0


def finite(c: Column) -> Column:
    """The value, or NULL where it is NULL, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def usable(c: Column, mark: float | None = None) -> Column:
    """TRUE where a reading carries a finite value other than the missing mark; never NULL."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok & (c != F.lit(mark)) if mark is not None else ok


def known(predicate: Column) -> Column:
    """A comparison whose unknown result counts as FALSE."""
    return F.coalesce(predicate, F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC timestamp with or without zone (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def r9(c) -> Column:
    """Rounded to nine decimals, ties shifted aside, so that results compare across engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-11), 9)


def sql9(text: str) -> str:
    """SQL with the same rounding: every ``round(x, 9)`` shifts ties as ``r9`` does."""
    return text.replace(", 9)", " + 1e-11, 9)")
