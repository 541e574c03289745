"""Raw lines of particle tables: the valid rows as numbers, the others with the reason.

Lines are first read permissively under the explicit schema, which keeps the raw text of what doesn't fit. A line that
fits and is written with digits, points, signs and exponents only is taken as it is. Every other line is classified
again by its quoting, its number of fields and a cast of each field, which also saves valid rows in unusual notation.

Blank lines, comment lines and null lines are no rows and give neither a row nor a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.functions.columns import let
from tomoframe.schema import TBL_COLUMNS

BLANK = r"[ \t]"
#: A decimal number; the same with a signed imaginary part; what may stand for a missing value.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
FIELD = rf"^({NUMBER})(?:[+-](?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[iIjJ])?\z"
NAN = r"^[nN][aA][nN]\z"
QUOTED = r'(?<![^ \t])"[^"]*"(?![^ \t])'
#: Fields that must have a number within a range of their own.
RULED = ("tag", "tdrot", "fs1")
_VERDICT = "_verdict"
SCHEMA = ", ".join(f"{c} double" for c in TBL_COLUMNS) + ", corrupt string"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _rule(name: str, value: Column) -> Column:
    if name == "tag":
        return (value >= 1) & (value == F.floor(value))
    if name == "tdrot":
        return value.between(-360, 360)
    return value.isin(0.0, 1.0)


def _verdict(bare: Column) -> Column:
    """struct(reason, cast) of a line without blanks around it."""
    n = len(TBL_COLUMNS)
    single = F.regexp_replace(bare, rf"{BLANK}+", " ")
    read = F.from_csv(single, SCHEMA, {"sep": " ", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    fast = let(read, lambda r: F.when(r["corrupt"].isNull(), F.array(*(r[c] for c in TBL_COLUMNS))))
    fast = let(fast, lambda v: F.when(F.forall(v, _finite), v))

    # What that doesn't take: tokens by quoting, then their number, then the cast of each.
    broken = F.regexp_replace(bare, QUOTED, "").contains('"')
    tokens = F.regexp_extract_all(bare, F.lit(r'("[^"]*"|[^ \t]+)'), 1)
    tokens = F.transform(tokens, lambda t: F.when(t.startswith('"'), F.regexp_replace(t, rf'^"{BLANK}*|{BLANK}*"\z', "")).otherwise(t))
    cast = lambda ts: F.transform(ts, lambda t: F.when(t.rlike(NAN), F.lit(float("nan"))).otherwise(F.regexp_extract(t, FIELD, 1).try_cast("double")))
    slow = F.when(~broken, let(tokens, lambda ts: F.when(F.size(ts) == n, cast(ts))))

    def judged(v: Column) -> Column:
        bad = F.exists(v, lambda x: x.isNull() | (F.abs(x) == float("inf")))
        reason = F.when(v.isNull(), F.when(broken, "quoting").otherwise("columns")).when(bad, "value")
        for name in RULED:
            x = v[TBL_COLUMNS.index(name)]
            reason = reason.when(F.isnan(x) | ~_rule(name, x), name)
        return F.struct(reason.alias("reason"), v.alias("cast"))

    plain = F.when(bare.rlike(r"^[0-9+\-.eE \t]*\z"), fast)
    return let(F.coalesce(plain, slow), judged)


def classified(lines: DataFrame, line: str = "line") -> DataFrame:
    """`lines` without blanks and comments, with `row` (a struct of 35 doubles; null if not valid) and `reason`.

    reason: null for a valid row, else 'quoting', 'columns', 'value' (a field is no finite number) or the name of the
    first of tag, tdrot and fs1 whose value is not allowed. A `nan` counts as null in the row.
    `row` and `reason` replace columns of these names; other columns of `lines` stay.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(line), r"\r\z", ""), rf"^{BLANK}+|{BLANK}+\z", "")
    rows = lines.where(let(bare, lambda b: b.isNotNull() & (b != "") & ~b.startswith("#")))
    # A generator makes the verdict, so that it isn't computed again for a filter on it.
    judged = rows.withColumn(_VERDICT, F.explode(F.array(let(bare, _verdict))))
    cast = [F.get(f"{_VERDICT}.cast", F.lit(i)) for i in range(len(TBL_COLUMNS))]
    row = F.struct(*(F.when(~F.isnan(v), v).alias(c) for v, c in zip(cast, TBL_COLUMNS)))
    return judged.withColumns({"reason": F.col(f"{_VERDICT}.reason"), "row": F.when(F.col(f"{_VERDICT}.reason").isNull(), row)}).drop(_VERDICT)
