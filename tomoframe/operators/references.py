"""References to records that do not exist, at the time of the reference.

References and changes of parents become one stream of events. It is range-partitioned by key and time, so that
references and parent keys lie together and a key with very many rows is spread over several partitions, and sorted.
Each partition is then merged in one pass that keeps running counts of the parents of the current key. Only the first
key of a partition can go on from earlier partitions; its counts are completed from one summary row per partition.

Empty tables give no rows. A null key or a null time is no reference; a parent without a start is never live, but its
key counts as known. A parent whose end isn't after its start was never live either. Equal rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.session import broadcast_if_small, written

BEFORE_ALL = -(2**63)
COUNTS = ("known", "begun", "live")
#: The reason of an orphan, and how it is chosen where a reference has two keys: the largest that holds.
MISSING, LATE, DELETED = 0, 1, 2


def _changes(parents: DataFrame) -> DataFrame:
    """Events of parents (key, begins, ends), in microseconds: what they add to each count, summed by key and moment."""
    lives = F.col("begins").isNotNull() & (F.col("ends").isNull() | (F.col("ends") > F.col("begins")))
    one, none = F.lit(1), F.lit(0)
    event = lambda t, known, begun, live: F.struct(t.alias("t"), known.alias("known"), begun.alias("begun"), live.alias("live"))
    events = F.filter(
        F.array(
            event(F.lit(BEFORE_ALL), one, none, none),
            event(F.col("begins"), none, one, lives.cast("int")),
            event(F.when(lives, F.col("ends")), none, none, F.lit(-1)),
        ),
        lambda e: e["t"].isNotNull(),
    )
    return (
        parents.where("key is not null")
        .select("key", F.explode(events).alias("e"))
        .groupBy("key", "e.t")
        .agg(*(F.sum(f"e.{c}").cast("bigint").alias(c) for c in COUNTS))
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition. Out come the references without a live parent so far in this partition, and a
    last row (src_table null) with the sums of the last key. `open`: the key is the first one, so that earlier partitions count too."""
    key, sums, first, at = None, np.zeros(3, np.int64), True, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        at = batch.column("pid")[0].as_py()
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        new[0] = keys[0].as_py() != key
        if key is None:
            new[0] = False  # the first key of the partition goes on, perhaps, from the one before
        elif new[0]:
            first = False
        starts = np.flatnonzero(new)
        run = np.cumsum(new)
        counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], 1)
        total = np.cumsum(counts, 0)
        base = np.zeros((run[-1] + 1, 3), np.int64)
        base[0] = -sums if not new[0] else 0
        base[1:] = (total - counts)[starts]
        total -= base[run]
        is_open = (run == 0) & first
        is_ref = batch.column("is_ref").to_numpy(zero_copy_only=False).astype(bool)
        out = np.flatnonzero(is_ref & (total[:, 2] <= 0))
        if len(starts):
            first = False
        key, sums = keys[len(keys) - 1].as_py(), total[-1]
        take = batch.take(pa.array(out))
        yield pa.RecordBatch.from_arrays(
            [*(take.column(c) for c in ("pid", "key", "src_table", "row_key", "t", "n_keys")), pa.array(is_open[out]), *(pa.array(total[out, i]) for i in range(3))],
            schema=_MERGED,
        )
    if key is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([key]), pa.array([None], pa.string()), pa.array([0]), pa.array([0]), pa.array([0], pa.int32()), pa.array([first]), *(pa.array([int(x)]) for x in sums)],
            schema=_MERGED,
        )


_MERGED = pa.schema([("pid", pa.int32()), ("key", pa.string()), ("src_table", pa.string()), ("row_key", pa.int64()), ("t", pa.int64()), ("n_keys", pa.int32()), ("open", pa.bool_()), *((c, pa.int64()) for c in COUNTS)])
_MERGED_DDL = "pid int, key string, src_table string, row_key bigint, t bigint, n_keys int, open boolean, known bigint, begun bigint, live bigint"


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a live parent at their time, with the reason.

    references: src_table, row_key BIGINT, key STRING, t BIGINT (microseconds), n_keys INT: under how many keys this
    row looks for its parent (it comes once for each; any one live parent is enough).
    parents: key STRING, begins, ends BIGINT (microseconds; live from begins on until before ends).
    Returns src_table, row_key, t, reason: 'missing' (no parent ever), 'late' (parents begin later) or 'deleted'.
    """
    zero = [F.lit(0).cast("bigint").alias(c) for c in COUNTS]
    refs = references.where("key is not null and t is not null").select("key", "t", F.lit(True).alias("is_ref"), "src_table", "row_key", F.col("n_keys").cast("int").alias("n_keys"), *zero)
    changes = _changes(parents).select("key", "t", F.lit(False).alias("is_ref"), F.lit(None).cast("string").alias("src_table"), F.lit(0).cast("bigint").alias("row_key"), F.lit(0).alias("n_keys"), *COUNTS)
    order = ["key", "t", "is_ref", "row_key"]
    merged = written(
        refs.unionByName(changes).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).mapInArrow(_merge, _MERGED_DDL),
        "merged",
    )
    # A key that goes on in later partitions: the sums of all partitions that it ended, up to the last one.
    before = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = merged.where("src_table is null").select(F.col("pid").alias("from_pid"), "key", *(F.sum(c).over(before).alias(f"{c}_before") for c in COUNTS), F.lead("pid").over(Window.partitionBy("key").orderBy("pid")).alias("to_pid"))
    orphans = merged.where("src_table is not null and not open")
    unsure = (
        merged.where("src_table is not null and open").alias("m")
        .join(broadcast_if_small(ends, cheap=True).alias("e"), F.expr("m.key = e.key and m.pid > e.from_pid and (e.to_pid is null or m.pid <= e.to_pid)"), "left")
        .select("m.pid", "m.key", "m.src_table", "m.row_key", "m.t", "m.n_keys", "m.open", *((F.col(f"m.{c}") + F.coalesce(f"e.{c}_before", F.lit(0))).alias(c) for c in COUNTS))
        .where("live <= 0")
    )
    rank = F.when(F.col("begun") > 0, DELETED).when(F.col("known") > 0, LATE).otherwise(MISSING)
    judged = orphans.unionByName(unsure).select("src_table", "row_key", "t", "n_keys", rank.alias("rank"))
    twice = judged.where("n_keys > 1").groupBy("src_table", "row_key", "t", "n_keys").agg(F.max("rank").alias("rank"), F.count("*").alias("n")).where("n >= n_keys").drop("n")
    reason = F.when(F.col("rank") == DELETED, "deleted").when(F.col("rank") == LATE, "late").otherwise("missing")
    return judged.where("n_keys <= 1").unionByName(twice).select("src_table", "row_key", "t", reason.alias("reason"))
