from __future__ import annotations

import json

import numpy as np
import pytest
import yaml

from tomoframe import __main__ as cli
from tomoframe.config import merged, settings
from tomoframe.functions import volume as v
from tomoframe.sources import mrc, tables


def test_settings():
    assert merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}, "d": 3}
    with pytest.warns(UserWarning, match="use_gpu"):
        s = settings({"use_gpu": True, "cone_step": 20, "references": ["a", "b"]}, sidelength=8)
    assert s.search.cone_step == 20 and s.references == ("a", "b") and s.sidelength == 8
    with pytest.raises(ValueError, match="table"):
        s.need("table", "sidelength")


def test_wrong_calls(spark, tmp_path, capsys):
    assert cli.main([]) == 2 and cli.main(["nothing", "x"]) == 2
    assert cli.main(["crop", str(tmp_path / "none.yaml")]) == 1
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["code"] == "FileNotFoundError"


def run(tmp_path, command, **values):
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(values))
    assert cli.main([command, str(tmp_path / "s.yaml")]) == 0


def test_generate_align_classify_reconstruct_crop(spark, tmp_path):
    box = np.zeros((8, 8, 8), np.float32)
    box[2:6, 3:5, 2:4] = 1
    (tmp_path / "ref.mrc").write_bytes(mrc.encode(box, 4.0))
    (tmp_path / "ref2.mrc").write_bytes(mrc.encode(box[::-1].copy(), 4.0))
    data = str(tmp_path / "data")
    run(tmp_path, "gen_synthetic", reference=str(tmp_path / "ref.mrc"), output=data, count=6, noise=0.01)
    both = {"table": data + "/particles.tbl", "volumes": data}
    run(tmp_path, "reconstruction", **both, output=str(tmp_path / "average"))
    average, _ = mrc.decode((tmp_path / "average.mrc").read_bytes())
    assert v.ncc(average, box) > 0.6
    few = {"cone_range": 0, "inplane_range": 0, "shift_search": 1, "subpixel": False}
    run(tmp_path, "alignment", **both, **few, reference=str(tmp_path / "ref.mrc"), output=str(tmp_path / "aligned"))
    assert len([x for p in (tmp_path / "aligned.tbl").glob("part-*") for x in p.read_text().splitlines()]) == 6
    run(tmp_path, "classification", **both, **few, references=[str(tmp_path / "ref.mrc"), str(tmp_path / "ref2.mrc")], iterations=1, output=str(tmp_path / "classes"))
    assert (tmp_path / "classes/average_ref_002.mrc").exists()
    tomogram = np.random.default_rng(1).random((20, 20, 20)).astype(np.float32)
    (tmp_path / "t.mrc").write_bytes(mrc.encode(tomogram, 2.0))
    (tmp_path / "t.vll").write_text(f"{tmp_path}/t.mrc\n")
    row = ["0"] * 35
    row[0], row[1], row[19], row[23:26] = "5", "1", "1", ["10", "10", "10"]
    (tmp_path / "one.tbl").write_text(" ".join(row) + "\n")
    run(tmp_path, "crop", table=str(tmp_path / "one.tbl"), tomograms=str(tmp_path / "t.vll"), sidelength=8, output=str(tmp_path / "cubes"))
    cube, size = mrc.decode((tmp_path / "cubes/particle_000000000005.mrc").read_bytes())
    assert (cube == v.cropped(tomogram, 8, (10, 10, 10))[0]).all() and size == pytest.approx(2.0)


def star_lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def star_table(spark, folder):
    return tables.read_star(spark, str(folder))


@pytest.fixture(scope="module")
def lab(tmp_path_factory):
    """A tomogram with three bricks, its list, and native and STAR tables of them."""
    at = tmp_path_factory.mktemp("lab")
    tomogram = np.random.default_rng(2).normal(0, 0.01, (24, 26, 28)).astype(np.float32)
    box = np.zeros((8, 8, 8), np.float32)
    box[2:6, 3:5, 2:4] = 1
    where = [(10, 9, 8), (19, 18, 17), (9, 17, 11)]
    for x, y, z in where:
        v.embed(tomogram, box, (z - 1, y - 1, x - 1))
    (at / "tomos").mkdir()
    (at / "tomos/t.one.mrc").write_bytes(mrc.encode(tomogram, 2.0))
    (at / "ref.mrc").write_bytes(mrc.encode(box, 2.0))
    (at / "t.vll").write_text(f"# list\n{at}/tomos/t.zero.mrc\n\n {at}/tomos/t.one.mrc \n")
    lines = []
    for tag, (x, y, z) in enumerate(where, 1):
        row = ["0"] * 37
        row[0], row[1], row[2], row[19], row[23:26], row[33], row[35:] = str(tag), "1", "1", "2", [str(x), str(y), str(z)], "1", ["7.5", "8"]
        lines.append(" ".join(row))
    lines.append(" ".join(["9", "1", *["0"] * 17, "55", *["0"] * 3, "9", "9", "9"]))  # a tomogram that isn't listed
    (at / "p.tbl").write_text("\n".join(lines) + "\n")
    names = "rlnTomoName rlnCenteredCoordinateXAngst rlnCenteredCoordinateYAngst rlnCenteredCoordinateZAngst rlnAngleRot rlnAngleTilt rlnAnglePsi rlnOther".split()
    body = [f"t.one {(x - 14) * 2} {(y - 13) * 2} {(z - 12) * 2} 0 0 0 'a b'" for x, y, z in where] + ["nowhere 1 1 1 0 0 0 c"]
    optics = "data_optics\n\nloop_\n_rlnImageSizeX #1\n_rlnImageSizeY #2\n_rlnImageSizeZ #3\n28 26 24\n\n"
    (at / "p.star").write_text(optics + "data_particles\n\nloop_\n" + "".join(f"_{n} #{i}\n" for i, n in enumerate(names, 1)) + "\n".join(body) + "\n")
    return at


@pytest.mark.parametrize("table, size", [("p.tbl", [28, 26, 24]), ("p.tbl", None), ("p.star", None)])
def test_crop_writes_star_and_paths_are_relative_to_the_settings(spark, lab, table, size):
    out = f"cubes_{table[2:]}_{'sized' if size else 'bare'}"
    values = {"table": table, "tomograms": "t.vll", "sidelength": 8, "output": out, "pixel_size": 2.0, **({"tomogram_size": size} if size else {})}
    run(lab, "crop", **values)
    assert len(list((lab / out).glob("particle_*.mrc"))) == 3
    got = sorted(r.asDict().items() for r in star_table(spark, lab / out / "particles.star").drop("src_file", "at").collect())
    rows = [dict(r) for r in got]
    assert len(rows) == 3 and all(r["rlnImageName"].startswith(f"{lab}/{out}/particle_") for r in rows)
    assert ("rlnMicrographName" in rows[0]) == (table == "p.tbl") and "rlnOther" not in rows[0] and "tdrot" not in rows[0]
    centred = {float(r["rlnCenteredCoordinateXAngst"]) for r in rows} if "rlnCenteredCoordinateXAngst" in rows[0] else {(float(r["rlnCoordinateX"]) - 14) * 2 for r in rows}
    assert centred == {-8.0, 10.0, -10.0} and ("rlnCoordinateX" in rows[0]) == (table == "p.tbl" and size is None)
    if table == "p.tbl":
        assert {r["rlnMicrographName"] for r in rows} == {"t.one"}


def test_alignment_from_and_to_star(spark, lab):
    run(lab, "crop", table="p.tbl", tomograms=["tomos/none.mrc", "tomos/t.one.mrc"], sidelength=8, output="boxes", pixel_size=2.0)
    few = {"cone_range": 0, "inplane_range": 0, "shift_search": 1, "subpixel": False, "reference": "ref.mrc", "pixel_size": 2.0}
    run(lab, "alignment", table="boxes/particles.star", volumes="boxes", output="a_star", output_star="refined.star", **few)
    rows = star_table(spark, lab / "refined.star").collect()
    assert len(rows) == 3 and {"rlnImageName", "rlnMicrographName", "rlnOriginXAngst", "rlnCoordinateX"} <= set(rows[0].__fields__)
    assert all(float(r.rlnOriginXAngst) == float(r.rlnOriginYAngst) == float(r.rlnOriginZAngst) == 0 for r in rows)
    run(lab, "reconstruction", table="refined.star", output="mean", pixel_size=2.0)
    assert v.ncc(mrc.decode((lab / "mean.mrc").read_bytes())[0], mrc.decode((lab / "ref.mrc").read_bytes())[0]) > 0.99
    for pair_by in ("tag", "order"):
        run(lab, "alignment", table="p.tbl", volumes="boxes", output=f"a_{pair_by}", output_star=f"{pair_by}.star", pair_by=pair_by, **few)
        lines = [x.split() for x in star_lines(lab / f"a_{pair_by}.tbl")]
        assert [x[0] for x in lines] == (["1", "2", "3"] if pair_by == "tag" else ["1", "2", "3", "9"])
        names = [r.rlnImageName for r in star_table(spark, lab / f"{pair_by}.star").collect()]
        assert len(names) == len(lines) and all(n.startswith(f"{lab}/boxes/particle_") for n in names)


def test_relative_image_names_and_tables_for_each_reference(spark, lab):
    run(lab, "crop", table="p.tbl", tomograms="t.vll", sidelength=8, output="sub/boxes", pixel_size=2.0)
    (lab / "sub/some.star").write_text("data_\nloop_\n_rlnImageName\n_tag\nboxes/particle_000000000001.mrc 1\nparticle_000000000002.mrc 2\nlost.mrc 3\n")
    few = {"cone_range": 0, "inplane_range": 0, "shift_search": 0, "subpixel": False}
    run(lab, "classification", tables=["sub/some.star"], volumes="sub/boxes", references=["ref.mrc"], iterations=1, output="one_class", **few)
    assert [x.split()[0] for x in star_lines(lab / "one_class/refined")] == ["1", "2"]
    (lab / "s.yaml").write_text(yaml.safe_dump({"tables": ["sub/some.star"] * 2, "references": ["ref.mrc"], "output": "x"}))
    assert cli.main(["classification", str(lab / "s.yaml")]) == 1


def test_columns_beyond_the_35th(spark, lab):
    rows = tables.read_tbl(spark, str(lab / "p.tbl")).orderBy("at").collect()
    assert [(r.col36, r.col37) for r in rows] == [(7.5, 8.0)] * 3 + [(None, None)] and rows[0].x == 10
