"""Recording and unit names: every accepted spelling maps onto one key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a recording's name.
STEM = r"(\d{4}\.\d{2}\.\d{2})[-.](\d{2}\.\d{2}\.\d{2})"
UNIT = r"(?i)^\s*unit_?0*(\d+)\s*$"


def recording_key(name: Column | str) -> Column:
    """``YYYY.MM.DD-hh.mm.ss-Rec`` for any spelling of a recording; NULL where there is none."""
    c = F.col(name) if isinstance(name, str) else name
    day, clock = F.regexp_extract(c, STEM, 1), F.regexp_extract(c, STEM, 2)
    return F.when(day != "", F.concat(day, F.lit("-"), clock, F.lit("-Rec")))


def unit_number(name: Column | str) -> Column:
    """The number in ``unit_044``; NULL where there is none."""
    c = F.col(name) if isinstance(name, str) else name
    digits = F.regexp_extract(c, UNIT, 1)
    return F.when(digits != "", digits.cast("long"))


def usable(value: Column | str, low: float | None = 0.0, high: float | None = None) -> Column:
    """True where a number is present: not NULL, not NaN and within its range; NULL or false elsewhere.

    A plain conjunction, so that a filter on it reaches the Parquet scan.
    """
    c = F.col(value) if isinstance(value, str) else value
    ok = c.isNotNull() & ~F.isnan(c)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return ok
