"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.session import broadcast_if_small, written

_PARTITION_BIT = 33


def with_ordinal(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """`df` with the number of each row in `order`, from 0 on. `order` should be total; rows equal in it come in any order.

    Rows are range-partitioned and sorted once; the number is the place in the partition plus the rows of all partitions
    before it, of which there is one small sum per partition. An existing column `name` is replaced.
    """
    spark_rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", _PARTITION_BIT))
    sizes = spark_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    return spark_rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")


def first_seen_ids(df: DataFrame, key: str, order: str, name: str = "id") -> DataFrame:
    """Each non-null value of `key` with a dense number by first appearance in `order`, from 1 on. Only the distinct values are numbered."""
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_at"))
    return with_ordinal(firsts, ["first_at", key], name).withColumn(name, F.col(name) + 1)


def cyclic_join(rows: DataFrame, row_order: list[str], items: DataFrame, item_order: list[str]) -> DataFrame:
    """Row i with item i; too few items begin again from the first, and items beyond the last row stay alone (left columns null).

    No items: rows alone. Adds `ordinal`, the place of the row, or of the item where it stays alone.
    """
    n_rows, n_items = rows.count(), items.count()
    left, right = with_ordinal(rows, row_order, "ordinal"), with_ordinal(items, item_order, "_item")
    if not n_items:
        return left.join(right.drop("_item").limit(0), F.lit(False), "left")
    # Few items take many rows each, so they are broadcast where their size allows it; many take few each.
    paired = left.withColumn("_item", F.pmod("ordinal", F.lit(n_items))).join(broadcast_if_small(right, cheap=True), "_item", "left").drop("_item")
    if n_items <= n_rows:
        return paired
    alone = right.where(F.col("_item") >= n_rows).withColumnRenamed("_item", "ordinal")
    return paired.unionByName(alone, allowMissingColumns=True)
