"""An extension beside the batch operators: running results over particle rows that keep arriving.

A stream of native rows gives windowed counts and score means with a watermark for late rows, and a running state per
tomogram through foreachBatch, which replaces only the keys that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomoframe.functions.columns import number, whole


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_scores(rows: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows, scores and mean score per window and tomogram. Rows later than `late` behind the newest are left out of closed
    windows; null tomograms and null times make no row; NaN and null scores count as rows only."""
    return (
        rows.select(F.col(time).cast("timestamp").alias("at"), whole("tomo").alias("tomo"), number("cc").alias("cc"))
        .where("tomo is not null and at is not null")
        .withWatermark("at", late)
        .groupBy(F.window("at", window), "tomo")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("cc").alias("n_cc"), F.avg("cc").alias("mean_cc"))
        .select("window.start", "tomo", "n_rows", "n_cc", "mean_cc")
    )


def running_states(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts and score sums per tomogram, kept as one compact Parquet table per batch under `folder`; `latest` reads them.

    Each batch writes only its own sums, under its number, so that a batch that is run again replaces itself.
    """

    def add(batch: DataFrame, number_of_batch: int) -> None:
        sums = batch.select(whole("tomo").alias("tomo"), number("cc").alias("cc")).where("tomo is not null").groupBy("tomo").agg(F.count(F.lit(1)).alias("n_rows"), F.count("cc").alias("n_cc"), F.sum("cc").alias("sum_cc"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number_of_batch}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The running state: the sums of all batches so far, combined."""
    sums = spark.read.schema("tomo bigint, n_rows bigint, n_cc bigint, sum_cc double, batch bigint").parquet(folder)
    total = sums.groupBy("tomo").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_cc", "sum_cc")))
    return total.select("tomo", "n_rows", F.when(F.col("n_cc") > 0, F.col("sum_cc") / F.col("n_cc")).alias("mean_cc"))
