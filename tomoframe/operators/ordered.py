"""Places and neighbours of rows within groups, where one group may hold most of the table.

A window over the group would give a large group to one task. Here rows are range-sorted by group and order, so that a
large group spreads over several partitions; the window runs over the part of a group in one partition, and what reaches
over its ends comes from one row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.session import written

_PARTITION_BIT = 33


def in_order(df: DataFrame, keys: list[str], order: list[str], neighbours: list[str] = (), firsts: list[str] = ()) -> DataFrame:
    """`df` with `place` (from 1) and `group_size` within the rows of equal `keys` by `order`, `previous_C` and `next_C` for each C
    of `neighbours` (null at the ends), and `first_C` for each C of `firsts`.

    Rows that are equal in `order` come in any order. Null keys are a group. Existing columns of the new names are replaced.
    """
    new = ["place", "group_size", *(f"{p}_{c}" for c in neighbours for p in ("previous", "next")), *(f"first_{c}" for c in firsts)]
    rows = df.drop(*new)
    by = [*keys, *order]
    rows = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "in_order").withColumn("_part", F.shiftright("_at", _PARTITION_BIT))
    # A null key joins with itself here.
    hashed = F.xxhash64(*(F.struct(F.col(k), F.col(k).isNull()) for k in keys))
    part = ["_part", "_key"]
    rows = rows.withColumn("_key", F.struct(hashed, *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("string"))
    ends = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.min_by(c, "_at").alias(f"_head_{c}") for c in dict.fromkeys([*neighbours, *firsts])),
        *(F.max_by(c, "_at").alias(f"_tail_{c}") for c in neighbours),
    )
    group = Window.partitionBy("_key")
    along = group.orderBy("_part")
    summed: list[Column] = [F.sum("_n").over(group).alias("group_size"), (F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before")]
    summed += [e for c in neighbours for e in (F.lag(f"_tail_{c}").over(along).alias(f"_previous_{c}"), F.lead(f"_head_{c}").over(along).alias(f"_next_{c}"))]
    summed += [F.first(f"_head_{c}").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(f"first_{c}") for c in firsts]
    ends = ends.select(*part, "_n", *summed)
    own = Window.partitionBy(*part).orderBy("_at")
    inner = rows.withColumn("_place", F.row_number().over(own))
    for c in neighbours:
        inner = inner.withColumn(f"_in_previous_{c}", F.lag(c).over(own)).withColumn(f"_in_next_{c}", F.lead(c).over(own))
    out = inner.join(ends, part).withColumn("place", F.col("_before") + F.col("_place"))
    for c in neighbours:
        out = out.withColumn(f"previous_{c}", F.when(F.col("_place") == 1, F.col(f"_previous_{c}")).otherwise(F.col(f"_in_previous_{c}")))
        out = out.withColumn(f"next_{c}", F.when(F.col("_place") == F.col("_n"), F.col(f"_next_{c}")).otherwise(F.col(f"_in_next_{c}")))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("_at", "_part", "_key")), *new)
