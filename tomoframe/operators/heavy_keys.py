"""Results per key where a few keys hold most rows: eager aggregation through joins.

Both inputs of the join are first reduced to one compact state per join key, inside the tasks that read them, so that
a key with a third of all rows leaves each task as one state. The states are joined, counts are multiplied and sums
scaled by the other side's count, and the result is rolled up. No row of a heavy key is ever moved.

Every count that comes out is one of the join: the rows of a key are those with a match and those without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.functions.columns import number


def states(rows: DataFrame, keys: list[str], values: list[str], angles: list[str] = ()) -> DataFrame:
    """One state per combination of keys: n rows, and for each value its sum and count, for each angle (degrees) the
    sums of its cosine and sine as well. NaN counts as null. Null keys make a combination of their own."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggregates += [F.sum(number(v)).alias(f"sum_{v}"), F.count(number(v)).alias(f"n_{v}")]
    for a in angles:
        aggregates += [F.sum(F.cos(F.radians(number(a)))).alias(f"cos_{a}"), F.sum(F.sin(F.radians(number(a)))).alias(f"sin_{a}"), F.count(number(a)).alias(f"n_{a}")]
    return rows.groupBy(*keys).agg(*aggregates)


def join_states(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join of two tables of states on `key`: adds `n_matches`, the right side's rows per left row, and
    `n_pairs`, the rows that the join of the unreduced inputs would have. Null keys match nothing."""
    other = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n_matches"))
    return left.join(other, key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn("n_pairs", F.col("n") * F.col("n_matches"))


def rolled_up(joined: DataFrame, fields: list[str], values: list[str], angles: list[str] = ()) -> DataFrame:
    """States summed per value of each field, and turned into results: field, key_value, n_matched and n_unmatched (rows with
    and without a match), n_rows (both), n_pairs, mean_V per value V, mean_A (direction of the mean vector, degrees) and
    spread_A (its length) per angle.

    A mean is null without values; mean_A also where the vectors cancel out. Null keys give no row.
    """
    sums = [c for c in joined.columns if c.startswith(("sum_", "n_", "cos_", "sin_")) and c not in ("n_matches", "n_pairs")]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("key_value")) for f in fields)))
    summed = (
        joined.select(pairs.alias("k"), "n", "n_matches", "n_pairs", *sums)
        .where("k.key_value is not null")
        .groupBy("k.field", "k.key_value")
        .agg(
            F.sum(F.when(F.col("n_matches") > 0, F.col("n")).otherwise(0)).alias("n_matched"),
            F.sum(F.when(F.col("n_matches") > 0, 0).otherwise(F.col("n"))).alias("n_unmatched"),
            F.sum("n_pairs").alias("n_pairs"),
            *(F.sum(c).alias(c) for c in sums),
        )
    )

    def length(a: str) -> Column:
        return F.sqrt(F.col(f"cos_{a}") * F.col(f"cos_{a}") + F.col(f"sin_{a}") * F.col(f"sin_{a}")) / F.col(f"n_{a}")

    means = [F.when(F.col(f"n_{v}") > 0, F.col(f"sum_{v}") / F.col(f"n_{v}")).alias(f"mean_{v}") for v in values]
    for a in angles:
        some = F.col(f"n_{a}") > 0
        means += [F.when(some & (length(a) > 1e-6), F.degrees(F.atan2(f"sin_{a}", f"cos_{a}"))).alias(f"mean_{a}"), F.when(some, length(a)).alias(f"spread_{a}")]
    return summed.select("field", "key_value", (F.col("n_matched") + F.col("n_unmatched")).alias("n_rows"), "n_matched", "n_unmatched", "n_pairs", *means)


def heavy(joined: DataFrame, fields: list[str], percent: int) -> DataFrame:
    """field, key_value, n_rows, n_matched, n_pairs of the keys that hold at least `percent` percent of all rows, those with null
    keys included. The total is one sum over the same states. No rows give no keys."""
    total = joined.agg(F.sum("n").alias("n")).scalar()
    return rolled_up(joined, fields, []).where(F.col("n_rows") * 100 >= total * percent).select("field", "key_value", "n_rows", "n_matched", "n_pairs")
