"""A score cutoff per source so that a target share of the source's rows is kept.

Rows are range-sorted by source and score, which spreads a source with very many rows over several partitions, and
written with their position. Rows are counted per partition and source; the running sum of these counts says in which
partition, and how far in, the row lies whose score is the cutoff. That exact row is then read. After the range sort no row is
moved again, unless the cutoffs of all sources are too large to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.functions.columns import number
from tomoframe.session import BROADCAST_BYTES, measured, written

#: monotonically_increasing_id has the partition above and the row within it below this bit.
PARTITION_BIT = 33


@dataclass(frozen=True)
class Kept:
    """cutoffs: the sources' columns, keep_pct, n_rows, cutoff, n_kept. rows: the sources' columns, score, id of the kept rows."""

    cutoffs: DataFrame
    rows: DataFrame


def keep_share(scored: DataFrame, source: list[str], score: str, row_id: str, keep_pct: str = "keep_pct") -> Kept:
    """Keeps of each source the rows with at least the highest score that at least keep_pct percent of its rows reach.

    `scored` has the columns of the source, the score, the id and the percentage, which is the same in all rows of a
    source. Rows with a null in a column of the source, a null percentage or a score that is null or NaN take no part.
    Rows with equal scores are kept or left together; repeated rows count each. A percentage of 100 or more keeps all
    rows, one of 0 or less those with the highest score. An empty table gives no cutoffs.
    """
    used = (
        scored.select(*(F.col(c) for c in source), (number(score) + 0.0).alias("_score"), F.col(row_id).alias("_id"), F.col(keep_pct).cast("bigint").alias("_pct"))
        .where("_score is not null and _pct is not null")
        .dropna(subset=source)
    )
    order = [*(F.col(c) for c in source), F.col("_score").desc(), F.col("_id")]
    placed = written(
        used.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_part", F.shiftright("_pos", PARTITION_BIT))

    chunks = placed.groupBy(*source, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"), F.max("_pct").alias("_pct"))
    of_source = Window.partitionBy(*source)
    chunks = (
        chunks.withColumn("n_rows", F.sum("n").over(of_source))
        .withColumn("upto", F.sum("n").over(of_source.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("wanted", F.least("n_rows", F.greatest(F.lit(1), F.expr("(n_rows * _pct + 99) div 100"))))
    )
    target = chunks.where("wanted <= upto and wanted > upto - n").select(*source, F.col("_pct").alias("keep_pct"), "n_rows", (F.col("first") + F.col("wanted") - (F.col("upto") - F.col("n")) - 1).alias("_pos"))
    # One row for each source goes to the sorted rows, which stay where they are unless these are too many.
    target = written(target, "target")
    small = measured(target) <= BROADCAST_BYTES
    exact = placed.select("_pos", "_score").join(F.broadcast(target) if small else target, "_pos")
    cutoffs = exact.select(*source, "keep_pct", "n_rows", F.col("_score").alias("cutoff"))
    scores = placed.select(*source, "_part", "_score", "_id")
    if small:
        kept = scores.join(F.broadcast(cutoffs), source)
    else:  # a join key with the partition keeps the rows of a large source apart
        kept = scores.join(chunks.select(*source, "_part").join(cutoffs, source), [*source, "_part"])
    kept = kept.where("_score >= cutoff")
    rows = kept.select(*source, F.col("_score").alias(score), F.col("_id").alias(row_id))
    report = kept.groupBy(*source).agg(F.max("keep_pct").alias("keep_pct"), F.max("n_rows").alias("n_rows"), F.max("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("n_kept"))
    return Kept(report, rows)
