from __future__ import annotations

import math
import random

import pytest

from tomoframe.llm import cutoff
from tomoframe.llm.cutoff import keep_share

SCHEMA = "tomo bigint, ref int, cc double, row_id bigint, keep_pct int, _pos string"


def brute(rows):
    by = {}
    for t, r, cc, i, p, _ in rows:
        if None not in (t, r, cc, p) and not math.isnan(cc):
            by.setdefault((t, r), []).append((cc, i, p))
    cut, kept = {}, []
    for k, own in by.items():
        n, pct = len(own), own[0][2]
        at = max(c for c, _, _ in own if sum(x >= c for x, _, _ in own) * 100 >= pct * n)
        ids = [i for c, i, _ in own if c >= at]
        cut[k] = (pct, n, at, len(ids))
        kept += ids
    return cut, sorted(kept)


def run(spark, rows):
    out = keep_share(spark.createDataFrame(rows, SCHEMA), ["tomo", "ref"], "cc", "row_id")
    return {(r.tomo, r.ref): (r.keep_pct, r.n_rows, r.cutoff, r.n_kept) for r in out.cutoffs.collect()}, sorted(r.row_id for r in out.rows.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_sources_with_ties_and_a_hot_one(spark, seed):
    rng = random.Random(seed)
    pct = {r: rng.choice([1, 5, 33, 50, 99, 100]) for r in (1, 2, 3)}
    rows = []
    for i in range(500):
        t = rng.choice([1] * 5 + [2, 3, None, -4])
        r = rng.choice([1, 1, 2, 3])
        cc = rng.choice([None, math.nan, 0.0, -0.0, math.inf, round(rng.random(), 1), round(rng.random(), 1), rng.random() * -70])
        rows.append((t, r, cc, i, pct[r], "x"))
    assert run(spark, rows) == brute(rows)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "BROADCAST_BYTES", 0)
    rows = [(i % 7, i % 2, float(i % 13), i, 30, None) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_one_score_only(spark):
    rows = [(1, 1, 0.5, 7, 10, None)] * 30 + [(1, 2, 0.1, i, 50, None) for i in range(4)]
    assert run(spark, rows) == brute(rows)


def test_limits(spark):
    rows = [(1, 1, float(i), i, 0, None) for i in range(5)] + [(2, 1, float(i), 10 + i, 250, None) for i in range(5)] + [(3, 1, 1.0, 99, None, None)]
    cut, kept = run(spark, rows)
    assert cut == {(1, 1): (0, 5, 4.0, 1), (2, 1): (250, 5, 0.0, 5)} and kept == [4, 10, 11, 12, 13, 14]


def test_empty(spark):
    assert run(spark, []) == ({}, [])
