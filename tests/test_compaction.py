from __future__ import annotations

from datetime import datetime

import pytest

from tomoframe.operators import compaction
from tomoframe.session import file_system, new_folder
from tomoframe.sources.star import blocks, parsed, particle_block, values

SCHEMA = "file_id bigint, path string, modified_at timestamp, n_bytes bigint, content string"
HEAD = "data_particles\n\nloop_\n_tag #1\n_rlnImageName #2\n"


def t(day):
    return datetime(2024, 1, day)


def test_current_states_and_equal_records(spark):
    rows = [
        (1, "a/x.star", t(1), 1, HEAD + "1 old.mrc\n"),
        (2, "a/x.star", t(2), 1, HEAD + "1 new.mrc\n2 'with blank.mrc'\n"),
        (3, "a/x.star", t(2), 1, HEAD + "1 new.mrc\n2 'with blank.mrc'\n"),
        (4, "a/_y.star", t(2), 1, HEAD + "9 no.mrc\n"),
        (5, ".y.star", t(2), 1, HEAD + "9 no.mrc\n"),
        (6, "b_/.c/z.star", t(1), 1, "data_optics\n\nloop_\n_tag\n_rlnImageName\n7 optics.mrc\n\ndata_\nloop_\n_rlnImageName\n_x\n_tag\n\"new.mrc\" 4 1\r\nq.mrc 5 3\r\ncut.mrc"),
        (7, "c.star", None, 1, HEAD + "4 n.mrc\n# 5 c.mrc\nnan m.mrc\n5.5 m.mrc\n6.0 six.mrc"),
        (8, "d.star", t(1), 1, None),
        (9, None, t(1), 1, HEAD + "8 nopath.mrc\n"),
        (10, "e.star", t(1), 1, "# nothing cropped\n"),
        (11, "f.star", t(1), 1, HEAD + "10 gone.mrc\n"),
        (12, "f.star", t(3), 1, ""),
    ]
    done = compaction.consolidated(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in done.rows.collect())
    assert got == [(1, "new.mrc"), (2, "with blank.mrc"), (3, "q.mrc"), (4, "n.mrc"), (6, "six.mrc")]
    assert done.counts == {"current_files": 5, "rows_read": 9, "cut": 1, "no_columns": 0, "no_tag": 2, "duplicates": 1, "records": 5}


def test_empty(spark):
    assert compaction.consolidated(spark.createDataFrame([], SCHEMA)).rows.count() == 0


def test_files_are_sorted_and_replaced(spark):
    folder = new_folder(spark, "compact")
    rows = spark.range(1000).selectExpr("id % 250 tag", "concat('n', id) image_name")
    compaction.compact(rows, ["tag", "image_name"], folder, target_bytes=4000)
    fs, at = file_system(spark, folder)
    files = [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
    assert 3 <= len(files) <= 5
    spans = sorted((r[0], r[1]) for f in files for r in spark.read.parquet(f).selectExpr("min(tag)", "max(tag)").collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    again = compaction.compact(rows.where("tag < 10"), ["tag", "image_name"], folder)
    assert again.count() == 40 and spark.read.parquet(folder).count() == 40


def test_a_lost_row_leaves_the_folder(spark, monkeypatch):
    folder = new_folder(spark, "compact")
    rows = spark.range(10).selectExpr("id tag", "'x' image_name")
    compaction.compact(rows, ["tag"], folder)
    real, seen = compaction._summary, []
    monkeypatch.setattr(compaction, "_summary", lambda df: (seen.append(1), real(df if len(seen) == 1 else df.limit(9)))[1])
    with pytest.raises(RuntimeError):
        compaction.compact(rows, ["tag"], folder)
    assert spark.read.parquet(folder).where("image_name = 'x'").count() == 10


@pytest.mark.parametrize("text, want", [("1 'a b' c", ["1", "a b", "c"]), ('"a""b"  x', ['a""b', "x"]), ("it's 2", ["it's", "2"]), ("\t1\t2 ", ["1", "2"])])
def test_values(text, want):
    assert values(text) == want


def test_blocks():
    assert blocks("data_a\n_x 1\n_y 'two words'\n") == [("a", ["_x", "_y"], [["1", "two words"]])]
    assert particle_block("data_b\nloop_\n_p\n1\ndata_particles\nloop_\n_q\n2\n") == (["_q"], [["2"]])
    assert particle_block("") == ([], []) and particle_block("junk\n1 2") == ([], [])


def test_cut_rows_are_counted():
    text = "data_particles\nloop_\n_a\n_b\n1\n2\n3\n4 5\n6\ndata_x\n_k v\n"
    assert [(b.name, b.rows, b.n_cut) for b in parsed(text)] == [("particles", [["1", "2"], ["4", "5"]], 2), ("x", [["v"]], 0)]


@pytest.mark.parametrize("fails", [1, 2])
def test_a_rename_that_fails_leaves_the_folder(spark, monkeypatch, fails):
    folder = new_folder(spark, "compact")
    rows = spark.range(10).selectExpr("id tag", "'x' image_name")
    compaction.compact(rows, ["tag"], folder)
    real, seen = compaction._rename, []
    monkeypatch.setattr(compaction, "_rename", lambda *a: (seen.append(1), len(seen) != fails and real(*a))[1])
    with pytest.raises(RuntimeError, match="unchanged"):
        compaction.compact(rows.limit(3), ["tag"], folder)
    monkeypatch.setattr(compaction, "_rename", real)
    assert spark.read.parquet(folder).count() == 10
    fs, at = file_system(spark, folder)
    assert [s.getPath().getName() for s in fs.listStatus(at.getParent()) if s.getPath().getName().startswith(at.getName())] == [at.getName()]


def test_a_run_that_ended_between_the_renames_is_made_good(spark):
    folder = new_folder(spark, "compact")
    rows = spark.range(10).selectExpr("id tag", "'x' image_name")
    compaction.compact(rows, ["tag"], folder)
    fs, at = file_system(spark, folder)
    _, aside = file_system(spark, folder + ".old-1")
    fs.rename(at, aside)
    again = compaction.compact(spark.read.schema("tag bigint, image_name string").parquet(folder + ".old-1").where("tag < 4"), ["tag"], folder + "2")
    assert again.count() == 4 and not fs.exists(at)  # another folder's affairs are left alone
    assert compaction._recover(spark, folder) == [] and spark.read.parquet(folder).count() == 10
    spark.read.parquet(folder).limit(2).write.parquet(folder + ".old-2")  # left by a run that ended after the renames
    compaction.compact(rows.limit(7), ["tag"], folder)
    assert spark.read.parquet(folder).count() == 7 and not fs.exists(file_system(spark, folder + ".old-2")[1])
