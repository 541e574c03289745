"""The first means of classification come from all vectors."""

from __future__ import annotations

import numpy as np

from tomoframe.plans import vector_queries


def test_class_of_odd_ids_has_a_mean(spark, tmp_path):
    rng = np.random.default_rng(1)
    kinds = rng.normal(size=(3, 64))
    rows = [(i, k, (kinds[k] + rng.normal(size=64) / 10).tolist()) for i, k in ((i, 2 if i in (5, 11) else i // 2 % 2) for i in range(20))]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.ref, r.pos): r["mean"] for r in vector_queries.mra_iterate_all(spark, str(tmp_path)).collect()}
    assert {ref for ref, _ in got} == {0, 1, 2}
    want = np.mean([e for i, k, e in rows if k == 2], axis=0)
    assert np.allclose([got[2, p] for p in range(64)], want, atol=1e-4)
