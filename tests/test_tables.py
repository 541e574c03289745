from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tomoframe.functions import geometry as g
from tomoframe.operators import conversion
from tomoframe.operators.ordered import in_order
from tomoframe.operators.ordinals import cyclic_join, first_seen_ids, with_ordinal
from tomoframe.sources import tables


def test_ordinals(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i, "clash") for i in range(300)] + [(None, 900, "clash")]
    df = spark.createDataFrame(rows, "k int, id int, ordinal string").repartition(5)
    got = [(r.k, r.id) for r in sorted(with_ordinal(df, ["k", "id"]).collect(), key=lambda r: r.ordinal)]
    assert got == sorted([r[:2] for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert with_ordinal(df.limit(0), ["k"]).count() == 0
    seen = {r.k: r.n for r in first_seen_ids(df, "k", "id", "n").collect()}
    order = list(dict.fromkeys(r[0] for r in rows if r[0] is not None))
    assert seen == {k: i + 1 for i, k in enumerate(order)}


def test_cyclic_join(spark):
    rows = spark.range(5).withColumnRenamed("id", "r")
    few, many, none = (spark.range(n).withColumnRenamed("id", "i") for n in (2, 7, 0))
    assert sorted((r.r, r.i) for r in cyclic_join(rows, ["r"], few, ["i"]).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    assert sorted(((r.r, r.i) for r in cyclic_join(rows, ["r"], many, ["i"]).collect()), key=str)[-2:] == [(None, 5), (None, 6)]
    assert [r.i for r in cyclic_join(rows, ["r"], none, ["i"]).collect()] == [None] * 5


def test_tbl_there_and_back(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1 1 0 0.5 1.25e-3 -2 30 40 0+1.2e-06i 0.123456789\r\n\n  2\t1 x nan 5 6\n" + " ".join(["7"] * 40) + "\n")
    got = tables.read_tbl(spark, str(tmp_path / "a.tbl")).orderBy("at").collect()
    assert len(got) == 3 and (got[0].narot, got[0].cc, got[0].cpu) == (0.0, 0.123456789, None)
    assert (got[1].averaged, got[1].dx, got[1].dy, got[2].sref) == (None, None, 5.0, 7.0)
    rows = tables.read_tbl(spark, str(tmp_path / "a.tbl")).withColumn("ref", F.lit(2.5))
    tables.write_tbl(rows, str(tmp_path / "out"), "at")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    first = next(x for x in lines if x.startswith("1 1 0 0.5 0.00125 -2 30 40 0 0.123457"))
    assert len(lines) == 3 and len(first.split()) == 35 and first.split()[33] == "2"
    again = tables.read_tbl(spark, str(tmp_path / "out")).orderBy("tag").collect()
    assert [r.tag for r in again] == [1.0, 2.0, 7.0]


def test_vll(spark, tmp_path):
    (tmp_path / "l.vll").write_text("# list\n/p/t1.mrc\n\n  /q/t1.mrc \n/q/a.b.mrc\nnone\n.hidden\n")
    got = [(r.tomo_id, r.rlnMicrographName, r.tomo_path) for r in tables.read_vll(spark, str(tmp_path / "l.vll")).orderBy("tomo_id").collect()]
    assert got == [(1, "t1", "/p/t1.mrc"), (2, "t1", "/q/t1.mrc"), (3, "a.b", "/q/a.b.mrc"), (4, "none", "none"), (5, ".hidden", ".hidden")]


def test_star_there_and_back(spark, tmp_path):
    rows = [(i, f"dir/p {i}.mrc" if i % 3 else f"p{i}.mrc", None if i == 4 else "t'x") for i in range(50)]
    df = spark.createDataFrame(rows, "tag bigint, rlnImageName string, rlnMicrographName string")
    tables.write_star(df, str(tmp_path / "out"), ["tag"])
    for p in (tmp_path / "out").glob("*.txt"):
        p.rename(p.with_suffix(".star"))
    spark.dataSource.register(tables.StarDataSource)
    got = sorted(tuple(r) for r in spark.read.format("star").load(str(tmp_path / "out")).collect())
    assert got == [(a, b, c or "") for a, b, c in rows]
    typed = spark.read.format("star").schema("tag int, x double").load(str(tmp_path / "out"))
    assert typed.where("x is null").count() == 50


def test_euler_forms(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-180, 180), rng.uniform(0, 180), rng.uniform(-180, 180)) for _ in range(50)] + [(10.0, 0.0, 20.0), (10.0, 180.0, 20.0)]
    df = spark.createDataFrame(rows, "a double, b double, n double")
    cols = tuple(F.col(c) for c in "abn")
    m, back = g.zxz_matrix(*cols), g.zxz_matrix(*g.matrix_to_zxz(g.zxz_matrix(*cols)))
    again = g.zyz_to_zxz(*g.zxz_to_zyz(*cols))
    worst = [F.abs(m[i][j] - back[i][j]) for i in range(3) for j in range(3)] + [F.abs(F.sin(F.radians(x - y))) for x, y in zip(cols, again)]
    assert df.select(F.greatest(*worst).alias("w")).agg(F.max("w")).first()[0] < 1e-7
    zyz = g.zxz_to_zyz(*cols)
    rot, tilt, psi = zyz  # Rz(rot) Ry(tilt) Rz(psi) is the same matrix
    y = [[F.cos(F.radians(tilt)), F.lit(0.0), F.sin(F.radians(tilt))], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [-F.sin(F.radians(tilt)), F.lit(0.0), F.cos(F.radians(tilt))]]
    same = g.product(g.product(g._z(rot), y), g._z(psi))
    assert df.select(F.greatest(*(F.abs(m[i][j] - same[i][j]) for i in range(3) for j in range(3))).alias("w")).agg(F.max("w")).first()[0] < 1e-9


def test_conversion(spark, tmp_path):
    rows = [(1.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 1.5, -2.0, 0.0, 1.2), (2.0, None, 0.0, 0.0, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0, 9.7)]
    df = spark.createDataFrame(rows, "tag double, x double, y double, z double, tdrot double, tilt double, narot double, dx double, dy double, dz double, tomo double")
    star = conversion.to_star(df, 4.0, (100, 200, 50))
    got = {r.tag: r for r in star.collect()}
    assert (got[1].rlnCenteredCoordinateXAngst, got[1].rlnOriginXAngst, got[1].rlnAngleRot, got[1].rlnAnglePsi) == (-160.0, -6.0, -50.0, 150.0)
    assert got[2].rlnCenteredCoordinateXAngst is None and got[2].rlnAngleRot is None and got[2].rlnMicrographName == "9"
    back = {r.tag: r for r in conversion.from_star(star, 4.0, (100, 200, 50)).collect()}
    assert all(abs(getattr(back[1], c) - v) < 1e-9 for c, v in zip(("x", "y", "z", "tdrot", "tilt", "narot", "dx", "dy", "dz"), rows[0][1:]))
    with pytest.raises(ValueError):
        conversion.to_star(df)
    with pytest.raises(ValueError):
        conversion.to_star(df.drop("tilt"), 1.0, (1, 1, 1))
    listed = spark.createDataFrame([(1, "a", "/a.mrc")], "tomo_id bigint, rlnMicrographName string, tomo_path string")
    named = {r.tag: (r.rlnMicrographName, r.tomo_path) for r in conversion.with_names(df, listed).collect()}
    assert named == {1.0: ("a", "/a.mrc"), 2.0: ("9", None)}
    (tmp_path / "a.tbl").write_text(" ".join(["3"] * 35) + "\n")
    (tmp_path / "a.vll").write_text("/x/one.mrc\n/x/two.mrc\n/x/three.mrc\n")
    conversion.tbl_to_star(spark, str(tmp_path / "a.tbl"), str(tmp_path / "a.vll"), str(tmp_path / "star"), centred=False)
    assert any("three" in p.read_text() for p in (tmp_path / "star").glob("*.txt"))


def test_first_existing(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, None, "y"), (1, "a", "b")], "i int, p string, q string")
    listing = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string")
    got = sorted((r.i, r.found) for r in conversion.first_existing(df, [F.col("p"), F.col("q")], listing).collect() if r.found)
    assert got == [(1, "a"), (1, "a"), (2, "b")]


def test_in_order_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 8 + ["b", "c", None]), i, rng.choice([None, 1, 2, 3]), "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v int, place string").repartition(6)
    got = {r.t: r for r in in_order(df, ["k"], ["t"], ["v"], ["t"]).collect()}
    for k in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == k]
        for i, (_, t, x, _) in enumerate(own):
            want = (i + 1, len(own), own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None, own[0][1], x)
            assert (got[t].place, got[t].group_size, got[t].previous_v, got[t].next_v, got[t].first_t, got[t].v) == want
    assert len(got) == 500 and in_order(df.limit(0), ["k"], ["t"], ["v"]).count() == 0
