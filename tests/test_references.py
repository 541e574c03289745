from __future__ import annotations

import random

import pytest

from tomoframe.operators.references import orphan_references

REFS = "src_table string, row_key bigint, key string, t bigint, n_keys int"
PARENTS = "key string, begins bigint, ends bigint"


def brute(refs, parents):
    found = {}
    for table, row, key, t, n in refs:
        if key is None or t is None:
            continue
        own = [(b, e) for k, b, e in parents if k == key]
        live = any(b is not None and b <= t and (e is None or t < e) for b, e in own)
        begun = any(b is not None and b <= t for b, e in own)
        found.setdefault((table, row, t, n), []).append(None if live else 2 if begun else 1 if own else 0)
    return sorted((*k[:3], ("missing", "late", "deleted")[max(v)]) for k, v in found.items() if None not in v)


def run(spark, refs, parents):
    return sorted(tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect())


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_and_a_hot_key(spark, seed):
    rng = random.Random(seed)
    keys = ["a"] * 6 + [f"k{i}" for i in range(12)] + [None]
    refs = [("t", i, rng.choice(keys), rng.choice([None, *range(60)]), 1) for i in range(400)]
    parents = []
    for _ in range(40):
        b = rng.choice([None, *range(60)])
        parents.append((rng.choice(keys), b, rng.choice([None, *range(60)])))
    assert run(spark, refs, parents) == brute(refs, parents)


def test_bounds_of_an_interval(spark):
    refs = [("t", i, "a", t, 1) for i, t in enumerate((9, 10, 19, 20, 25))]
    assert run(spark, refs, [("a", 10, 20)]) == [("t", 0, 9, "late"), ("t", 3, 20, "deleted"), ("t", 4, 25, "deleted")]


def test_two_keys_of_one_row(spark):
    refs = [("t", 1, "n:5", 3, 2), ("t", 1, "i:5", 3, 2), ("t", 2, "n:6", 3, 2), ("t", 2, "i:6", 3, 2)]
    assert run(spark, refs, [("i:5", 0, None), ("n:6", 5, None)]) == [("t", 2, 3, "late")]


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, None)]) == []
    assert run(spark, [("t", 1, "a", 5, 1)], []) == [("t", 1, 5, "missing")]
    assert run(spark, [], []) == []
