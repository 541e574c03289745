from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tomoframe.session import table
from tomoframe.streaming.arrivals import arriving, latest, running_states, windowed_scores


def parts(spark, data, folder):
    rows = table(spark, data, "dynamo_tbl").select("row_id", "tomo", "cc", "loaded_at")
    rows.repartition(5).write.parquet(folder)
    return rows, rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")


def test_running_states_equal_the_batch_result(spark, data, tmp_path):
    rows, schema = parts(spark, data, str(tmp_path / "in"))
    stream = arriving(spark, str(tmp_path / "in"), schema, files_per_batch=2)
    running_states(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    good = F.col("cc").isNotNull() & ~F.isnan("cc")
    want = rows.where("tomo is not null").groupBy(F.round("tomo").cast("bigint").alias("tomo")).agg(F.count("*").alias("n"), F.avg(F.when(good, F.col("cc"))).alias("m"))
    got = {r.tomo: (r.n_rows, r.mean_cc) for r in latest(spark, str(tmp_path / "out")).collect()}
    for r in want.collect():
        n, mean = got.pop(r.tomo)
        assert n == r.n and mean == (r.m if r.m is None else pytest.approx(r.m))
    assert not got
    batches = {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")}
    assert len(batches) == 3


def test_windows(spark, data, tmp_path):
    rows, schema = parts(spark, data, str(tmp_path / "in"))
    stream = windowed_scores(arriving(spark, str(tmp_path / "in"), schema), late="5000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scores").agg(F.sum("n_rows")).first()[0] == rows.where("tomo is not null").count()
