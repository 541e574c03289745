from __future__ import annotations

import math

from tomoframe.operators import heavy_keys as h
from tomoframe.plans.data_work import p3_found

ROWS = "tomo bigint, ref bigint, cc double, tdrot double, extra string"


def test_states_equal_the_plain_join(spark):
    rows = [(1, 1, 0.5, 10.0, "x")] * 50 + [(1, 2, None, 350.0, "x"), (2, 1, math.nan, None, "y"), (None, 2, 0.1, 5.0, None), (3, None, 0.2, 90.0, "z"), (3, None, 0.4, -90.0, "z")]
    entries = [(1,), (1,), (3,), (None,)]
    left = spark.createDataFrame(rows, ROWS)
    right = spark.createDataFrame(entries, "tomo bigint")
    joined = h.join_states(h.states(left, ["tomo", "ref"], ["cc"], ["tdrot"]), h.states(right, ["tomo"], []), "tomo")
    got = {(r.field, r.key_value): r for r in h.rolled_up(joined, ["tomo", "ref"], ["cc"], ["tdrot"]).collect()}
    plain = left.join(right, "tomo").groupBy("tomo").count().collect()
    assert {r.tomo: r["count"] for r in plain} == {k: got["tomo", k].n_pairs for k in (1, 3)}
    assert got["tomo", 1].n_rows == 51 and got["tomo", 1].n_matched == 51 and abs(got["tomo", 1].mean_cc - 0.5) < 1e-12
    assert got["tomo", 2].n_pairs == 0 and got["tomo", 2].mean_cc is None and got["tomo", 2].mean_tdrot is None
    assert got["tomo", 3].mean_tdrot is None and got["tomo", 3].spread_tdrot < 1e-9  # opposite directions
    assert ("tomo", None) not in got and got["ref", 2].n_rows == 2


def test_empty(spark):
    left = spark.createDataFrame([], ROWS)
    right = spark.createDataFrame([], "tomo bigint")
    joined = h.join_states(h.states(left, ["tomo", "ref"], ["cc"]), h.states(right, ["tomo"], []), "tomo")
    assert h.rolled_up(joined, ["tomo", "ref"], ["cc"]).count() == 0


def test_heavy_counts_null_keys_in_the_total_and_keeps_the_join(spark, data):
    left = spark.createDataFrame([(1, 1, 0.5, 10.0, "x")] * 3 + [(None, 1, 0.5, 1.0, "x")] * 97, ROWS)
    right = spark.createDataFrame([(1,), (1,)], "tomo bigint")
    joined = lambda l, r: h.join_states(h.states(l, ["tomo", "ref"], []), h.states(r, ["tomo"], []), "tomo")
    assert sorted(map(tuple, h.heavy(joined(left, right), ["tomo", "ref"], 3).collect())) == [("ref", 1, 100, 3, 6), ("tomo", 1, 3, 3, 6)]
    assert [r.field for r in h.heavy(joined(left, right), ["tomo", "ref"], 4).collect()] == ["ref"]
    assert h.heavy(joined(left.limit(0), right), ["tomo", "ref"], 3).count() == 0
    plan = p3_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "vll.parquet" in "".join(p3_found(spark, data).inputFiles())
