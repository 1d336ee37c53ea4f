"""Time completion and parsing.

The raw feed carries times as text in several shapes: a full date, a bare clock time
of the current day, or a month-day without a year. These helpers complete and parse
them with Catalyst expressions only, so parsing runs inside whole-stage codegen. A text is
reduced to its shape (letters as A, digits as 9); the shape picks the rewriting to ISO.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

# Month abbreviations that mark a "month-day" time such as "Aug-07".
MONTH_ABBREVIATIONS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                       "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Shapes of the texts that ``parse_time`` rewrites, upper-cased, with every letter as A and
# every digit as 9. All others go to Spark's own cast, which covers the ISO shapes.
SHAPE_CLOCK = ("9999-99-99 9:99AA", "9999-99-99 99:99AA")
SHAPE_SLASHED = "9999/99/99"
SHAPE_MONTH_FIRST = "99/99/9999"
SHAPE_MONTH_NAME = ("AAA 9 9999", "AAA 99 9999")

_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complete_time(c, as_of: _dt.date | str, rollback_future: bool = False) -> Column:
    """Complete a partial time string against the ``as_of`` date.

    Order of the rules: (1) stripped text longer than 8 characters holding ``/`` or
    ``-`` is kept; (2) text naming a month ("Aug-07") becomes ``yyyy-MM-dd`` in the
    year of ``as_of`` (null when it does not parse, instead of stopping the job);
    (3) text with AM, PM or ``:`` is prefixed with the ``as_of`` date; (4) anything else
    is kept. The result is the stripped text. Null stays null.

    ``rollback_future=True`` moves a month-day that would fall after ``as_of`` into the
    previous year ("Dec-31" read on 1 January is last year's date).
    """
    as_of = _dt.date.fromisoformat(str(as_of)) if not isinstance(as_of, _dt.date) else as_of
    s = F.trim(_c(c))
    has_month = s.rlike("|".join(MONTH_ABBREVIATIONS))
    month_day = F.upper(F.concat(F.regexp_replace(s, "-", " "), F.lit(f" {as_of.year}")))
    parsed = F.when(shape_of(month_day).isin(*SHAPE_MONTH_NAME), _month_name_iso(month_day)).try_cast("date")
    if rollback_future:
        parsed = F.when(parsed > F.lit(as_of), F.add_months(parsed, -12)).otherwise(parsed)
    month_date = parsed.cast("string")
    is_clock = F.upper(s).rlike("AM|PM") | s.contains(":")
    # null text falls through every test and comes out null
    return (
        F.when((F.length(s) > 8) & s.rlike("[/-]"), s)
        .when(has_month, month_date)
        .when(is_clock, F.concat(F.lit(as_of.isoformat() + " "), s))
        .otherwise(s)
    )


def shape_of(upper: Column) -> Column:
    """Upper-case text with every letter A to Z as ``A`` and every digit as ``9``."""
    return F.translate(upper, _LETTERS + _DIGITS, "A" * 26 + "9" * 10)


def _month_name_iso(upper: Column) -> Column:
    """``AUG 7 2024`` as ``2024-08-07``; null for letters that are no month."""
    place = F.instr(F.lit("".join(MONTH_ABBREVIATIONS).upper()), F.substring(upper, 1, 3)) - 1
    month = F.when((place >= 0) & (place % 3 == 0), F.lpad((place / 3 + 1).cast("int").cast("string"), 2, "0"))
    day = F.lpad(F.substring_index(F.substring(upper, 5, 2), " ", 1), 2, "0")
    return F.concat(F.substring(upper, -4, 4), F.lit("-"), month, F.lit("-"), day)


def _clock_iso(upper: Column) -> Column:
    """``2024-01-05 2:05PM`` as ``2024-01-05 14:05``; null for an hour that a 12-hour clock lacks."""
    hour = F.substring_index(F.substring(upper, 12, 2), ":", 1).cast("int")
    hour_of_day = hour % 12 + F.when(upper.endswith("PM"), 12).otherwise(0)
    minute = F.substring(upper, -4, 2)
    return F.when(hour.between(1, 12), F.concat(
        F.substring(upper, 1, 11), F.lpad(hour_of_day.cast("string"), 2, "0"), F.lit(":"), minute))


def parse_time(c) -> Column:
    """Parse a time string to a ``timestamp_ntz`` in three tiers.

    Blank text or text starting with "loading" is null; ``yyyy-MM-dd`` exactly is a
    date at midnight; then ``yyyy-MM-dd h:mma`` (AM/PM in either case); then ``yyyy/MM/dd``,
    ``MM/dd/yyyy``, ``MMM d yyyy`` and Spark's own cast. Anything else is null.

    The text's shape picks how it is rewritten to ISO, and one cast parses it, so the generated
    code holds one parser and does not depend on the session time zone.
    """
    s = F.trim(_c(c))
    upper = F.upper(s)
    shape = shape_of(upper)
    iso = (F.when(shape.isin(*SHAPE_CLOCK) & upper.rlike("[AP]M$"), _clock_iso(upper))
           .when(shape == SHAPE_SLASHED, F.translate(s, "/", "-"))
           .when(shape == SHAPE_MONTH_FIRST,
                 F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 1, 2), F.lit("-"), F.substring(s, 4, 2)))
           .when(shape.isin(*SHAPE_MONTH_NAME), _month_name_iso(upper))
           .otherwise(s))
    return F.when(~F.lower(s).startswith("loading"), iso.try_cast("timestamp_ntz"))


def to_day(c, dtype=None) -> Column:
    """Calendar date of a time column (D3): strings are parsed first, null if unparseable."""
    c = _c(c)
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, StringType):
        return F.to_date(parse_time(c))
    if dtype is None or isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.to_date(c)
    raise TypeError(f"cannot take a day from {dtype}")


def day_of(df, col: str) -> Column:
    """``to_day`` that looks up the column type in ``df``."""
    return to_day(col, df.schema[col].dataType)
