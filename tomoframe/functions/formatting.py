"""Numbers as text and text as numbers, as the table formats have them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomoframe.functions.columns import let


@F.pandas_udf(T.StringType())
def general_format(values: pd.Series) -> pd.Series:
    """C's %.6g, which the JVM does not have: no trailing zeros, an exponent where it is shorter. Null stays null."""
    return values.map(lambda x: f"{x:.6g}", na_action="ignore")


def whole_format(value: Column) -> Column:
    """A number rounded half to even and printed without a point."""
    return F.rint(value).cast("bigint").cast("string")


def lenient_number(token: Column) -> Column:
    """The finite number that a token is, the real part of a complex one; null for anything else."""
    real = F.regexp_extract(token, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:[+-](?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[iIjJ])?\z", 1)
    value = let(real, lambda r: F.when(r != "", r.try_cast("double")))
    return let(value, lambda x: F.when(F.abs(x) < float("inf"), x))


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
