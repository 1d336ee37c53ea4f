"""Sums over trailing windows of any length as differences of prefix sums.

A window frame costs every row the frame's length; here it costs two rows. Every key (a
position or a day) sends its sums to its own place and, for each window length ``w``, asks
for the prefix at ``key - w``. Sums and questions are cut into chunks of consecutive keys;
a running sum inside each chunk plus the carried total of the chunks before it answers
both, and a window is the prefix at the key less the prefix that was asked for. Keys may
be missing and may hold several rows: the frame ``(key - w, key]`` counts what is there.

Sums are exact. Values are integers after scaling (``scaled``), added up as DECIMAL(38,0),
so that differences of long prefixes lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .partitioning import materialize

#: Consecutive keys of one chunk.
CHUNK_KEYS = 4096
#: Digits that an unscaled double keeps, relative to the largest of its column: with 28 for a square,
#: ten more remain for the number of rows.
DIGITS = 14
SUM = "decimal(38,0)"


def finite(col: str) -> Column:
    """``col`` as double; NaN and infinities count as missing."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def digits_of(df: DataFrame, cols: Sequence[str], scale: int | None) -> dict[str, int]:
    """Decimals that each column is scaled by: ``scale`` if the caller knows them, else so many that
    the largest value has ``DIGITS`` digits (one aggregate over the table)."""
    if scale is not None:
        return dict.fromkeys(cols, scale)
    top = df.agg(*[F.max(F.abs(finite(c))).alias(c) for c in cols]).first()
    return {c: DIGITS - math.ceil(math.log10(top[c])) if top[c] else 0 for c in cols}


def scaled(col: str, digits: int) -> Column:
    """``col`` times ``10**digits`` as an integer (half even)."""
    return F.rint(finite(col) * F.lit(10.0 ** digits)).cast(SUM)


def unscaled(total: Column, digits: int) -> Column:
    return total.cast("double") / F.lit(10.0 ** digits)


def window_sums(rows: DataFrame, key: str, back: Sequence[int], sums: dict[str, Column],
                partition_by: Sequence[str] = (), chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """One row per distinct ``key`` (an integer column; of each ``partition_by`` group): a struct
    ``w<b>`` per length ``b`` with every sum over the rows whose key is in ``(key - b, key]``.

    ``sums`` are integer expressions of a row, null for nothing. No task holds more than
    ``chunk_keys`` keys and the questions that fall between them.
    """
    pb, names = list(partition_by), list(sums)
    total = rows.groupBy(*pb, F.col(key).cast("bigint").alias("_of")).agg(
        *[F.coalesce(F.sum(e.cast(SUM)).cast(SUM), F.lit(0).cast(SUM)).alias(n) for n, e in sums.items()])
    total = materialize(total.where(F.col("_of").isNotNull()))
    nothing = F.struct(*[F.lit(0).cast(SUM).alias(n) for n in names])
    own = F.struct(*[F.col(n) for n in names])
    asked = total.select(*pb, "_of", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("back"), own.alias("s")),
        *[F.struct(F.lit(b).cast("bigint").alias("back"), nothing.alias("s")) for b in back])).alias("_q"))
    asked = (asked.select(*pb, "_of", F.col("_q.back").alias("_back"), (F.col("_of") - F.col("_q.back")).alias("_at"), "_q.s.*")
             .withColumn("_chunk", F.floor(F.col("_at") / chunk_keys)))
    chunks = asked.groupBy(*pb, "_chunk").agg(*[F.sum(n).cast(SUM).alias(n) for n in names])
    before = (Window.partitionBy(*pb) if pb else Window).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*pb, "_chunk", *[F.sum(n).over(before).cast(SUM).alias(f"_carry_{n}") for n in names])
    # of equal places all are included, whichever comes first
    upto = Window.partitionBy(*pb, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    prefix = asked.select(*pb, "_of", "_back", "_chunk", *[F.sum(n).over(upto).cast(SUM).alias(n) for n in names]).join(
        carry, [*pb, "_chunk"])
    prefix = prefix.select(*pb, "_of", "_back", *[
        (F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0).cast(SUM))).cast(SUM).alias(n) for n in names])
    picked = prefix.groupBy(*pb, "_of").agg(*[
        F.sum(F.when(F.col("_back") == b, F.col(n))).cast(SUM).alias(f"_{n}_{b}") for b in (0, *back) for n in names])
    return picked.select(*pb, F.col("_of").alias(key), *[
        F.struct(*[(F.col(f"_{n}_0") - F.col(f"_{n}_{b}")).cast(SUM).alias(n) for n in names]).alias(f"w{b}") for b in back])


def mean(n: Column, s: Column, digits: int) -> Column:
    return F.when(n > 0, unscaled(s, digits) / n.cast("double"))


def sample_std(n: Column, s: Column, squares: Column, digits: int) -> Column:
    """From exact sums of ``n`` integers and of their squares: squares about an integer next to
    the mean are exact too, and only what the mean has beyond it is rounded. Null for one."""
    near = F.rint(s.cast("double") / n.cast("double")).cast(SUM)
    about = (squares - (near * s * F.lit(2)).cast(SUM) + (n * (near * near).cast(SUM)).cast(SUM)).cast("double")
    rest = (s - (n * near).cast(SUM)).cast("double")
    count = n.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(about - rest * rest / count, F.lit(0.0)) / (count - 1)) / F.lit(10.0 ** digits))


def slope(n: Column, x: Column, xx: Column, y: Column, xy: Column, origin: Column, digits: int) -> Column:
    """Least-squares slope of y on x from exact sums, with x counted from ``origin``, a number in
    the window; null where all x are equal."""
    o = origin.cast(SUM)
    sx = (x - (n * o).cast(SUM)).cast(SUM)
    sxx = (xx - (o * x * F.lit(2)).cast(SUM) + (n * (o * o).cast(SUM)).cast(SUM)).cast(SUM)
    sxy = (xy - (o * y).cast(SUM)).cast(SUM)
    below = ((n * sxx).cast(SUM) - (sx * sx).cast(SUM)).cast("double")
    above = ((n * sxy).cast(SUM) - (sx * y).cast(SUM)).cast("double")
    return F.when(below > 0, above / below / F.lit(10.0 ** digits))
