from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.functions import volume as v
from tomoframe.functions.geometry import ring_size
from tomoframe.operators import volumes as ops
from tomoframe.plans import pipelines
from tomoframe.sources import mrc
from tomoframe.session import new_folder


def brick(side=24):
    box = np.zeros((side,) * 3, np.float32)
    at = lambda *x: tuple(slice(a * side // 24, b * side // 24) for a, b in zip(x[::2], x[1::2]))
    box[at(7, 17, 9, 15, 10, 14)] = 1
    box[at(14, 17, 9, 12, 10, 14)] = 2
    return v.low_passed(box, 4, 1)


def slow_sample(vol, at):
    out = []
    for p in at.T:
        if (p < 0).any() or (p > np.array(vol.shape) - 1).any():
            out.append(0.0)
            continue
        i = np.minimum(p.astype(int), np.maximum(np.array(vol.shape) - 2, 0))
        f = p - i
        s = 0.0
        for k in np.ndindex(2, 2, 2):
            w = np.prod([f[a] if k[a] else 1 - f[a] for a in range(3)])
            if w:
                s += w * vol[tuple(i + np.array(k))]
        out.append(s)
    return np.array(out)


def test_sampling():
    rng = np.random.default_rng(1)
    vol = rng.random((4, 5, 6)).astype(np.float32)
    at = rng.random((3, 400)) * [[5], [6], [7]] - 1
    assert np.allclose(v.sampled(vol, at), slow_sample(vol, at), atol=1e-6)
    assert np.allclose(v.sampled(vol, v._grid(vol.shape)), vol.ravel())
    assert np.allclose(v.zoomed(vol, (7, 9, 11))[[0, -1], [0, -1], [0, -1]], vol[[0, -1], [0, -1], [0, -1]])
    assert v.halved(vol).shape == (2, 2, 3)


def test_rotation_and_back():
    for pose in ((30, 20, 15, 2, -1, 1), (0, 90, 0, 0, 0, 0), (200, 170, -40, 0.5, 0, -2)):
        m = v.rotation(*pose[:3])
        assert np.allclose(v.rotation(*v.angles_of(m)), m)
        b = brick()
        assert v.ncc(v.aligned_back(v.posed(b, pose), pose), b) > 0.9
    box = np.zeros((5, 5, 5), np.float32)
    box[1, 2, 2] = 1
    assert v.turned(box, v.rotation(90, 0, 0))[2, 1:4, 2].max() == pytest.approx(1)


def test_shift_is_zero_padded_and_signed():
    box = np.zeros((9, 9, 9), np.float32)
    box[4, 4, 4] = 1
    assert v.shifted(box, (2, -1, 1))[6, 3, 5] == 1 and v.shifted(box, (5, 0, 0)).sum() == 0


@pytest.mark.parametrize("side", [8, 9])
def test_surface_equals_circular_shifts(side):
    rng = np.random.default_rng(3)
    a, b = rng.random((2, side, side, side))
    surface = v.ncc_surface(a, b)
    for s in ((0, 0, 0), (2, -1, 1), (-3, 0, 2)):
        assert surface[tuple(side // 2 + d for d in s)] == pytest.approx(v.ncc(a, np.roll(b, s, (0, 1, 2))))
    assert v.ncc_surface(a, np.ones_like(b)) is None and v.ncc(a, np.ones_like(b)) == 0.0


def test_box_mean_and_local_score():
    rng = np.random.default_rng(4)
    vol = rng.random((5, 6, 4))
    padded = np.pad(vol, 1)
    want = np.array([[[padded[i : i + 3, j : j + 3, k : k + 3].mean() for k in range(4)] for j in range(6)] for i in range(5)])
    assert np.allclose(v.box_mean(vol, 3), want)
    assert v.local_ncc(vol, 3 * vol) > 0.9 > abs(v.local_ncc(vol, rng.random(vol.shape)))
    assert v.local_ncc(vol, vol, np.zeros(vol.shape, bool)) == 0.0


@pytest.mark.parametrize("shape", [(8, 8, 8), (5, 7, 6)])
def test_wedge(shape):
    full = v.wedge(shape, 0, -60.0, 60.0, -60.0, 60.0)
    assert full.all() and v.wedge(shape, 9, -60.0, 60.0, -60.0, 60.0).all()
    y, x = v.wedge(shape, 1, -60.0, 60.0, -50.0, 50.0), v.wedge(shape, 2, -60.0, 60.0, -50.0, 50.0)
    assert 0 < y.sum() < full.sum() and (v.wedge(shape, 4, -60.0, 60.0, -50.0, 50.0) == y * x).all()
    assert v.wedge(shape, 1, -40.0, 40.0, 0.0, 0.0)[tuple(n // 2 for n in shape)] == 0
    vol = np.random.default_rng(5).random(shape).astype(np.float32)
    assert np.allclose(v.filtered(vol, full), vol, atol=1e-5)
    assert v.fitted_mask(y, (4, 6, 8)).shape == (4, 6, 8)


@pytest.mark.parametrize("mode, n", [("cube", 343), ("center_only", 1), ("ellipsoid", 123), ("cylinder_z_follow", 29 * 7)])
def test_shift_list(mode, n):
    assert len(v.shift_list(3, mode)) == n
    assert v.shift_list(0, mode) == [(0, 0, 0)]


def test_angle_list():
    assert v.angle_list(0, 10, 0, 10, (5, 6, 7))[0] == pytest.approx((5, 6, 7))
    some = v.angle_list(60, 15, 40, 20, (10, 50, 5))
    axis = v.rotation(10, 50, 0)[:, 2]
    assert all(np.degrees(np.arccos(np.clip(v.rotation(*a)[:, 2] @ axis, -1, 1))) <= 30 + 1e-6 for a in some)
    assert len({tuple(np.round(v.rotation(*a), 6).ravel()) for a in some}) == len(some)


def test_angle_list_counts_and_order(spark):
    """The rings of the half sphere as functions.geometry counts them, and the turns of the first axis."""
    counts = [r.n for r in spark.range(7).select(F.col("id"), ring_size(F.col("id") * 15.0, F.lit(15.0)).alias("n")).orderBy("id").collect()]
    rings = v.angle_list(180, 15, 0, 15)
    tilts = [round(float(np.degrees(np.arccos(np.clip(v.rotation(*a)[2, 2], -1, 1)))), 6) for a in rings]
    assert tilts == sorted(tilts) and [tilts.count(15 * k) for k in range(7)] == counts
    assert [a[2] for a in v.angle_list(0, 15, 60, 15)] == [0, 15, 30, -15, -30]
    assert v.angle_list(90, 0, 90, 0) == [(0, 0, 0)]


@pytest.mark.parametrize("search", [v.Search(60, 20, 60, 15, 2), v.Search(60, 20, 60, 15, 2, levels=2), v.Search(40, 20, 30, 15, 1, cc_mode="roseman_local", subpixel=False)])
def test_pose_is_found(search):
    b = brick()
    pose = v.angle_list(40, 20, 30, 15)[7] + (1.0, 0.0, -1.0)
    found = v.align(v.posed(b, pose), b, search)
    assert v.ncc(v.posed(b, found[:6]), v.posed(b, pose)) > 0.97
    assert np.allclose(found[3:6], pose[3:6], atol=0.6)


def test_subpixel_mask_and_flat():
    g = np.exp(-((np.indices((20, 20, 20)) - 10) ** 2).sum(0) / 18).astype(np.float32)
    found = v.align(v.shifted(g, (0.4, -0.35, 0.2)), g, v.Search(cone=0, inplane=0, shift=1))
    assert np.allclose(found[3:6], (0.4, -0.35, 0.2), atol=0.02)
    mask = np.zeros(g.shape, bool)
    mask[4:16, 4:16, 4:16] = True
    assert v.align(g, g, v.Search(cone=0, inplane=0, shift=1), mask)[6] == pytest.approx(1)
    assert v.align(np.zeros_like(g), g, v.Search(cone=0, inplane=0))[6] == 0
    assert v.quadratic_top(np.zeros(27)) is None and v.parabola_top(1, 1, 1) == 0


def test_together_as_alone():
    b, s = brick(16), v.Search(60, 30, 60, 30, 1, subpixel=False)
    ps = [v.posed(b, (10 * i, 5 * i, 0, i % 2, 0, 0)) for i in range(5)]
    assert np.allclose(v.align_many(ps, b, s), [v.align(p, b, s) for p in ps])
    flat = v.Search(60, 30, 60, 30, 0, subpixel=False)
    assert np.allclose(v.align_many(ps, b, flat), [v.align(p, b, flat) for p in ps])


@pytest.mark.parametrize("fill, shape", [(-1, (11, 10, 10)), (-2, (11, 10, 10)), (0, (16, 16, 16)), (1, None)])
def test_crop(fill, shape):
    vol = np.random.default_rng(6).random((20, 20, 18)).astype(np.float32)
    cube, outside = v.cropped(vol, 16, (4, 3, 3), fill)
    assert outside and (cube is None if shape is None else cube.shape == shape)
    whole, outside = v.cropped(vol, 8, (10, 10, 10), fill)
    assert not outside and (whole == vol[5:13, 5:13, 5:13]).all()
    if fill == 0:
        assert (cube[16 - 11 :, 6:, 6:] == vol[:11, :10, :10]).all() and cube[:5].sum() == 0
    assert fill == 1 or v.cropped(vol, 4, (99, 0, 0), fill)[0].sum() == 0


def test_embed():
    vol, p = np.zeros((6, 6, 6)), np.ones((3, 3, 3))
    v.embed(vol, p, (0, 5, 2.5))
    assert vol.sum() == 2 * 2 * 3 and vol[0, 5, 2] == 1
    v.embed(vol, p, (50, 5, 2))
    assert vol.sum() == 12


@pytest.mark.parametrize("order", "<>")
def test_mrc(order):
    vol = np.random.default_rng(7).random((3, 4, 5)).astype(np.float32)
    raw = bytearray(mrc.encode(vol, 4.284))
    back, size = mrc.decode(bytes(raw))
    assert (back == vol).all() and size == pytest.approx(4.284, rel=1e-6)
    with pytest.raises(ValueError):
        mrc.decode(bytes(raw[:-1]))
    with pytest.raises(ValueError):
        mrc.decode(b"short")
    short = np.arange(24, dtype=order + "i2")
    head = np.array([4, 3, 2, 1], order + "i4").tobytes() + bytes(76) + np.array([8], order + "i4").tobytes()
    head = head.ljust(208, b"\0") + b"MAP " + (b"\x44\x44" if order == "<" else b"\x11\x11")
    assert (mrc.decode(head.ljust(1024, b"\0") + b"extended" + short.tobytes())[0].ravel() == short).all()


def test_files_there_and_back(spark, tmp_path):
    rows = pipelines.synthetic(spark, brick(8), 3).selectExpr("concat('p', tag, '.mrc') path", "nz", "ny", "nx", "2.5D voxel_size", "data")
    mrc.write_volumes(rows, str(tmp_path / "out"))
    (tmp_path / "out/broken.mrc").write_bytes(b"xx")
    got = {r.path.rsplit("/", 1)[-1]: r for r in mrc.read_volumes(spark, str(tmp_path / "out")).collect()}
    assert got["broken.mrc"].error and got["p1.mrc"].voxel_size == pytest.approx(2.5)
    assert {r.path: bytes(r.data) for r in rows.collect()} == {k: bytes(r.data) for k, r in got.items() if not r.error}


def test_sums_do_not_depend_on_partitions(spark):
    rows = [(i % 2 if i % 5 else None, 2, 2, 1 + i % 2, np.full(4 * (1 + i % 2), i, "<f4").tobytes()) for i in range(40)]
    rows += [(1, 2, 2, 1, b"cut"), (1, 2, 2, 1, None), (1, None, 2, 1, b"")]
    df = spark.createDataFrame(rows, "k int, nz int, ny int, nx int, data binary")
    want = {}
    for k, nz, ny, nx, d in rows[:40]:
        want.setdefault((k, nx), []).append(np.frombuffer(d, "<f4")[0])
    for n in (1, 7):
        got = {(r.k, r.nx): (r.n, ops.box(r).ravel()[0]) for r in ops.volume_means(df.repartition(n), ["k"]).collect()}
        assert got == {k: (len(x), np.float32(np.mean(x))) for k, x in want.items()}
    assert ops.volume_means(df.limit(0), ["k"]).count() == 0


def test_errors_and_ties(spark):
    b = brick(8)
    rows = [(1, 8, 8, 8, b.tobytes()), (2, 8, 8, 8, b"cut"), (3, 8, 8, 8, None), (4, 2, 2, 2, np.ones(8, "<f4").tobytes())]
    df = spark.createDataFrame(rows, "tag bigint, nz int, ny int, nx int, data binary")
    got = {r.tag: r for r in ops.aligned(df, {2: b, 5: b}, v.Search(0, 30, 0, 30, 1), ["tag"]).collect()}
    assert got[1].ref == 2 and got[1].cc == pytest.approx(1) and got[1].error is None
    assert got[2].error and got[3].error and got[4].error == "no reference of this shape" and got[4].cc is None
    own = {r.tag: r.ref for r in ops.aligned(df.withColumn("ref", ops.F.lit(9)), {2: b, 5: b}, v.Search(0, 30, 0, 30, 0), ["tag"], own_reference=True).collect()}
    assert own[1] == 5


def test_pipelines(spark, tmp_path):
    b = brick(12)
    rows = pipelines.synthetic(spark, b, 12, noise=0.02, noise_only=2)
    poses = rows.where("ref = 1").withColumn("averaged", ops.F.lit(1))
    average = pipelines.reconstruct(poses)
    assert average.n == 12 and v.ncc(average.average, b) > 0.9
    assert pipelines.reconstruct(poses, tags=[1, 2, 99]).n == 2
    assert pipelines.reconstruct(poses.withColumn("averaged", ops.F.lit(None).cast("int"))).average is None
    still = rows.selectExpr("tag", "nz", "ny", "nx", "data").where("tag <= 2")
    done = pipelines.align(still, b, v.Search(0, 30, 0, 30, 2), ["tag"])
    assert done.n == 2 and done.rows.count() == 2


def test_classification_goes_on_where_it_stopped(spark, monkeypatch):
    b = brick(8)
    rows = pipelines.synthetic(spark, b, 6, noise=0.01, noise_only=3).selectExpr("tag", "nz", "ny", "nx", "data")
    refs, search = {1: b, 2: b[::-1].copy(), 3: np.zeros_like(b)}, v.Search(0, 30, 0, 30, 1, subpixel=False)
    folder = new_folder(spark, "classes")
    pipelines.classify(rows, refs, search, ["tag"], iterations=1, folder=folder)
    ran, real = [], ops.aligned
    monkeypatch.setattr(ops, "aligned", lambda *a, **k: (ran.append(1), real(*a, **k))[1])
    two = pipelines.classify(rows, refs, search, ["tag"], iterations=2, folder=folder)
    assert len(ran) == 1 and two.rows.count() == 9
    monkeypatch.undo()
    again = pipelines.classify(rows, refs, search, ["tag"], iterations=2)
    assert sorted((r.tag, r.ref) for r in two.rows.collect()) == sorted((r.tag, r.ref) for r in again.rows.collect())
    assert (two.references[3] == 0).all()  # no particle went there


def test_crop_from_files(spark, tmp_path):
    vol = np.random.default_rng(8).random((20, 24, 28)).astype(np.float32)
    (tmp_path / "t.mrc").write_bytes(mrc.encode(vol, 3.0))
    rows = [(1, 10.0, 12.0, 9.0, 1.0, str(tmp_path / "t.mrc")), (2, 2.0, 12.0, 9.0, None, str(tmp_path / "t.mrc")), (3, 10.0, 12.0, 9.0, 0.0, str(tmp_path / "t.mrc")), (4, 1.0, 1.0, 1.0, 1.0, str(tmp_path / "none.mrc"))]
    df = spark.createDataFrame(rows, "tag bigint, x double, y double, z double, aligned double, tomo_path string")
    got = {r.tag: r for r in pipelines.crop(df, 8, fill=1).collect()}
    assert set(got) == {1, 4} and got[4].error and got[1].voxel_size == pytest.approx(3.0)
    assert (ops.box(got[1]) == v.cropped(vol, 8, (9, 12, 10))[0]).all()
    assert {r.tag for r in pipelines.crop(df, 8, fill=0).collect()} == {1, 2, 4}
    with pytest.raises(ValueError):
        pipelines.crop(df, 7)


def test_functions_on_columns(spark):
    from tomoframe.functions import udfs

    b = brick(8)
    df = spark.createDataFrame([(1, 8, 8, 8, b.tobytes(), 30.0), (2, 8, 8, 8, b"cut", 30.0), (3, 8, 8, 8, None, 30.0), (4, 8, 8, 8, b.tobytes(), None)], "i int, nz int, ny int, nx int, data binary, a double")
    zero, f = ops.F.lit(0.0), ops.F
    got = {
        r.i: r
        for r in df.select(
            "i",
            udfs.rotate("data", f.col("a"), zero, zero).alias("t"),
            udfs.shift("data", f.lit(1.0), zero, zero).alias("s"),
            udfs.lowpass("data", f.lit(8.0), f.lit(1.0)).alias("l"),
            udfs.apply_wedge("data", f.lit(1), f.lit(-60.0), f.lit(60.0), zero, zero).alias("w"),
            udfs.symmetrise("data", f.lit(4)).alias("y"),
            udfs.inverse_transform("data", zero, zero, zero, f.lit(-1.0), zero, zero).alias("u"),
            udfs.ncc("data", "data").alias("n"),
            udfs.local_ncc("data", "data").alias("q"),
        ).collect()
    }
    as_box = lambda x: np.frombuffer(x, "<f4").reshape(8, 8, 8)
    assert np.allclose(as_box(got[1].t), v.turned(b, v.rotation(30, 0, 0))) and np.allclose(as_box(got[1].s), v.shifted(b, (1, 0, 0))) and (as_box(got[1].u) == as_box(got[1].s)).all()
    assert got[1].n == pytest.approx(1) and got[1].q > 0.5 and got[2].t is None and got[3].n is None and got[4].t is None and got[4].s is not None
    assert np.allclose(as_box(got[1].w), v.filtered(b, v.wedge(b.shape, 1, -60.0, 60.0, 0.0, 0.0)), atol=1e-6) and np.allclose(as_box(got[1].y), v.symmetrised(b, "c4"), atol=1e-6)
    spark.udtf.register("shift_candidates", udfs.shift_candidates)
    spark.udtf.register("angle_candidates", udfs.angle_candidates)
    assert spark.sql("select count(*) from shift_candidates(2, 'cube')").first()[0] == 125
    assert spark.sql("select count(*) from angle_candidates(60, 30, 0, 10)").first()[0] == len(v.angle_list(60, 30, 0, 10))


def test_tomogram_in_slabs(spark, tmp_path):
    b, size = brick(8), (30, 28, 25)
    where = pipelines.positions(spark, 6, size, 8)
    assert where.where("x < 4 or x > 26 or y < 4 or y > 24 or z < 4 or z > 21").count() == 0
    for slab in (7, 25):
        pipelines.write_tomogram(pipelines.tomogram(where, b, size, noise=0.001, ratio=1000.0, slab=slab), str(tmp_path / f"t{slab}.mrc"), size, 4.0)
    many, one = (mrc.decode((tmp_path / f"t{n}.mrc").read_bytes()) for n in (7, 25))
    assert many[0].shape == (25, 28, 30) and many[1] == pytest.approx(4.0) and np.allclose(many[0], one[0], atol=0.02)
    want = np.zeros((25, 28, 30), np.float32)
    for r in where.collect():
        v.embed(want, v.turned(b, v.rotation(r.tdrot, r.tilt, r.narot)), (r.z, r.y, r.x))
    assert v.ncc(one[0], want) > 0.99


def test_rows_as_json(spark, tmp_path):
    pipelines.write_rows_json(spark.createDataFrame([(1, 2, b"x"), (2, 1, b"y")], "tag int, ref int, data binary"), str(tmp_path / "j"))
    assert sorted(p.name for p in (tmp_path / "j").glob("ref=*")) == ["ref=1", "ref=2"] and spark.read.json(str(tmp_path / "j")).count() == 2


@pytest.mark.parametrize("direct", [v.DIRECT, 0])
def test_shifts_wider_than_the_box_do_not_go_around(monkeypatch, direct):
    monkeypatch.setattr(v, "DIRECT", direct)
    rng = np.random.default_rng(9)
    reference, particles = rng.random((3, 4, 4)).astype(np.float32), list(rng.random((4, 3, 4, 4)).astype(np.float32))
    search = v.Search(90, 30, 90, 30, 3, subpixel=False)
    turns = [v.turned(reference, v.rotation(*a)) for a in v.angle_list(90, 30, 90, 30)]
    for p, pose in zip(particles, v.align_many(particles, reference, search)):
        assert pose[6] == pytest.approx(max(v.ncc(p, v.shifted(t, s)) for t in turns for s in v.shift_list(3)))
        assert pose[6] == pytest.approx(v.ncc(p, v.posed(reference, pose[:6])), abs=1e-5)


def test_queries_search_all_poses_and_shapes(spark, tmp_path, monkeypatch):
    import datetime

    from tomoframe.plans import vector_queries

    b = brick(12)
    far = v.angle_list(360, 30, 360, 30)[400] + (2.0, 0.0, -2.0)
    boxes = [b] * 9 + [v.posed(b, far), b[:10], b[:10]]
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"p{i:02d}", *x.shape, x.astype("<f4").tobytes(), at) for i, x in enumerate(boxes)]
    spark.createDataFrame(rows, "path string, nz int, ny int, nx int, data binary, created_at timestamp").write.parquet(str(tmp_path / "tomo_volumes.parquet"))
    got = {r.path: r for r in vector_queries.align_volumes(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and not any(r.error for r in got.values())
    assert got["p09"].cc > 0.8 and [got[p].ref for p in ("p00", "p09", "p10")] == [1, 1, 2] and got["p10"].cc == pytest.approx(1, abs=1e-4)
    rounds, real = [], ops.aligned
    monkeypatch.setattr(ops, "aligned", lambda *a, **k: (rounds.append(1), real(*a, **k))[1])
    classes = {r.path: r for r in vector_queries.classify_volumes(spark, str(tmp_path)).collect()}
    assert len(rounds) == 3 and len(classes) == 12 and not any(r.error for r in classes.values())
    assert {classes[p].ref for p in ("p10", "p11")} <= {3, 4}


def test_auto_wedge_side_is_resolved_for_each_row(spark):
    b = brick(8)
    particle = v.filtered(v.posed(b, (0, 0, 0, 1, 0, 0)), v.wedge(b.shape, 1, -30.0, 30.0, 0.0, 0.0)) + np.random.default_rng(4).normal(0, 0.05, b.shape)
    flags = {1: (1.0, 1.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (None, None)}
    rows = spark.createDataFrame([(k, 8, 8, 8, particle.astype("<f4").tobytes(), 1.0, -30.0, 30.0, 0.0, 0.0, *f) for k, f in flags.items()], "tag int, nz int, ny int, nx int, data binary, ftype double, ymintilt double, ymaxtilt double, xmintilt double, xmaxtilt double, fs1 double, fs2 double")
    run = lambda side: {r.tag: r.cc for r in ops.aligned(rows, {1: b}, v.Search(0, 30, 0, 30, 1, subpixel=False, wedge_side=side), ["tag"]).collect()}
    auto, both, of_particle, of_template = run("auto"), run("both"), run("particle"), run("template")
    assert auto == {1: both[1], 2: of_particle[2], 3: of_template[3], 4: both[4]}
    assert len({round(x, 6) for x in auto.values()}) == 3
    assert run("AUTO") == auto and {r.cc for r in ops.aligned(rows.drop("fs1", "fs2"), {1: b}, v.Search(0, 30, 0, 30, 1, subpixel=False, wedge_side="auto"), ["tag"]).collect()} == {both[1]}


@pytest.mark.parametrize("own", [False, True])
def test_references_in_blocks(spark, monkeypatch, own):
    rng = np.random.default_rng(6)
    references = {k: rng.random((4, 4, 4)).astype(np.float32) for k in (1, 2, 3)} | {4: rng.random((3, 4, 4)).astype(np.float32)}
    boxes = [references[2], references[3] + references[1], references[4], references[1]]
    rows = [(i % 4, k, *b.shape, b.astype("<f4").tobytes()) for i, (b, k) in enumerate(zip([*boxes, boxes[0]], [3, None, 9, 2, 1]))] + [(8, 1, 4, 4, 4, b"cut")]
    df = spark.createDataFrame(rows, "tag int, ref int, nz int, ny int, nx int, data binary")
    run = lambda: sorted(map(tuple, ops.aligned(df, references, v.Search(0, 30, 0, 30, 1, subpixel=False), ["tag"], own_reference=own).collect()), key=str)
    want = run()
    monkeypatch.setattr(ops, "BLOCK_BYTES", 300)
    assert run() == want and len(want) == 6 and sum(r[-1] is None for r in want) >= 4
