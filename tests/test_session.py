from __future__ import annotations

import os

from pyspark.sql import functions as F

from tomoframe.plans.particle_queries import ordered_output
from tomoframe.plans.vector_queries import mra_assign
from tomoframe.session import broadcast_if_small, measured, scratch, shared_folder


def test_scratch_is_empty_after_the_result_is_written(spark, data, tmp_path):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark):
        for f in (ordered_output, mra_assign):
            f(spark, data).write.parquet(str(tmp_path / f.__name__))
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(str(tmp_path / "ordered_output")).count() > 0


def test_sides_are_measured_in_bytes(spark):
    wide = spark.range(100).select("id", F.expr("sequence(1, 1000)").alias("a"), F.expr("repeat('é', 500)").alias("s"), F.expr("named_struct('x', array('ab', null), 'm', map(1, 'abc'))").alias("n"))
    size = measured(wide)
    assert 100 * (8 * 1000 + 1000) < size < 100 * 10_000
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(wide, size + 1)) and not hinted(broadcast_if_small(wide, size - 1))
    assert measured(wide.limit(0)) == 0 and broadcast_if_small(wide.limit(0), cheap=True).count() == 0
