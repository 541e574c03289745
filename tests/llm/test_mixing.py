from __future__ import annotations

import os

import pytest

from tomoframe.llm import mixing, tokenizers

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokenizers.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary")
TARGETS = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 6), ("absent", 0.1, 3), (None, 0.2, 3), ("zero", 0.0, 3)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c", "word " * (1 + i % 40), "x") for i in range(4000)]
    docs += [(9001, "unasked", "text", "x"), (9002, None, "text", "x"), (9003, "a", None, "x"), (9004, "b", "", "x"), (None, "c", "no id", "x")]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string, copy string").repartition(4), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark, tables):
    got = {r.source: r for r in mixing.shares(*tables).collect()}
    assert set(got) == {"a", "b", "c", "absent"}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s].actual_share - share) < 0.01 and got[s].most_copies <= got[s].max_repeats
    assert got["absent"].mixed_tokens == 0


def test_rows_are_those_of_the_report(spark, tables):
    encode = tokenizers.byte_bpe()[0].encode_ordinary
    rows = mixing.mixed(*tables).collect()
    report = {r.source: r for r in mixing.shares(*tables).collect()}
    for s in ("a", "b", "c"):
        own = [r for r in rows if r.source == s]
        assert len(own) == report[s].n_copies and sum(len(encode(r.text or "")) for r in own) == report[s].mixed_tokens
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.source), []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed(tables[0].repartition(7), tables[1]).collect()), key=str)
    order = [r.doc_id for r in rows]
    assert order != sorted(order, key=lambda x: x or 0)


def test_total(spark, tables):
    small = mixing.shares(*tables, total_tokens=5000.0).collect()
    assert abs(sum(r.mixed_tokens for r in small) - 5000) < 300
    full = mixing.shares(*tables, total_tokens=1e15).collect()
    assert max(r.most_copies - r.max_repeats for r in full) == 0


@pytest.mark.parametrize("rate, most, mean", [(0.0, 3, 0), (0.7, 4, 0.699), (5.0, 3, 2.83), (3.0, 3, 2.328), (900.0, 900, 888.03), (2000.0, 10**9, 2000)])
def test_poisson(rate, most, mean):
    first, steps = mixing.poisson_steps(rate, most)
    assert len(steps) <= min(most, 18 * rate**0.5 + 60) and all(a <= b for a, b in zip(steps, steps[1:]))
    count = lambda u: first + int((steps <= u).sum())
    got = sum(count((i + 0.5) / 20_000) for i in range(20_000)) / 20_000
    assert got == pytest.approx(mean, abs=0.02 + 1e-4 * mean)
    assert max(count(u) for u in (0.5, 1 - 2**-53)) <= most and mixing.drawn_tokens(rate, most, mixing.np.ones(2048)) == pytest.approx(2048 * mean, rel=2e-3, abs=1)


def test_every_source_is_drawn(spark, tables):
    """No source has the same count for all its rows, however scarce it is; without repetition rows are in or out."""
    rows = mixing.mixed(*tables).groupBy("source", "doc_id").count().groupBy("source").agg(mixing.F.countDistinct("count").alias("n")).collect()
    report = {r.source: r for r in mixing.shares(*tables).collect()}
    assert {r.source for r in rows if r.n > 1} == {"a", "b", "c"}
    assert all(0 < report[s].rate <= report[s].max_repeats for s in "abc") and max(report[s].rate / report[s].max_repeats for s in "abc") == 1
    once = mixing.shares(tables[0], spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).first()
    assert once.rate == 1 and once.most_copies == 1 and 0.5 < once.n_copies / once.n_docs < 0.75


def test_many_sources_are_joined_in_parts(spark, tables, monkeypatch):
    want = sorted(map(tuple, mixing.shares(*tables).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.shares(*tables).collect()), key=str) == want


def test_nothing(spark, tables):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mixed(none, tables[1]).count() == 0
    assert all(r.mixed_tokens == 0 for r in mixing.shares(none, tables[1]).collect())
    assert mixing.mixed(tables[0], spark.createDataFrame([], "source string, target_share double, max_repeats int")).count() == 0
