"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond it a double can't be cast to BIGINT.
LARGEST = 9.2e18


def number(c: Column | str) -> Column:
    """A double, with NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def whole(c: Column | str) -> Column:
    """The nearest whole number as BIGINT (halves away from zero); null for null, NaN and what BIGINT can't hold."""
    c = number(c)
    return F.when(F.abs(c) < LARGEST, F.round(c)).cast("bigint")


def trimmed(c: Column | str) -> Column:
    """Without spaces, tabs and line ends around it; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(c != "", c)


def micros(c: Column | str) -> Column:
    """A timestamp, with or without a zone, as microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value of `c`, which is computed once however often the body names it."""
    return F.transform(F.array(c), body)[0]
