"""Numeric helpers (M1, M2) and null/NaN edge handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round4(c) -> Column:
    """Round to 4 decimals, half to even on the scaled value (M1).

    ``rint(x * 1e4) / 1e4`` is the array-library algorithm used for the aggregates; it
    also agrees with the probability rounding except at binary near-ties.
    """
    return F.rint(_c(c) * F.lit(1e4)) / F.lit(1e4)


def null_as_zero_flag(cond: Column) -> Column:
    """A 0/1 int flag where an unknown comparison counts as 0 (pandas NaN semantics)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def exact_sum(c, scale: int) -> Column:
    """Sum of values that carry at most ``scale`` decimals, added exactly as DECIMAL.

    For values that the caller knows to carry no more decimals the cast is lossless and the
    sum does not depend on how rows were split across tasks. Others would be cut.
    """
    return F.sum(_c(c).cast(f"decimal(24,{scale})"))


def mean_of(c, scale: int | None = None) -> Column:
    """The mean, null when there are no values: ``avg``, or with ``scale`` the exact decimal sum
    (see ``exact_sum``) over the count."""
    return F.avg(_c(c)) if scale is None else exact_sum(c, scale).cast("double") / F.count(_c(c))
