"""python -m tomoframe crop|reconstruction|alignment|classification|gen_synthetic settings.yaml

Particle tables are native (.tbl) or STAR (.star, or a folder of STAR files of that name). Files lie on folders that all executors
share; relative paths are relative to the settings' folder. Errors are one JSON line on standard error; the exit code is then 1.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.config import Settings, load
from tomoframe.functions.columns import whole
from tomoframe.operators import conversion
from tomoframe.operators.ordinals import cyclic_join
from tomoframe.plans import pipelines
from tomoframe.schema import POSE
from tomoframe.session import scratch, written
from tomoframe.sources import mrc, tables

#: Columns that come with a volume or come out of a search, and those that only serve to read a table.
_OF_VOLUME = {"path", "nz", "ny", "nx", "voxel_size", "data", "error"}
_OF_READER = {"size_x", "size_y", "size_z", "_found", "_end"}


def _one(path: str):
    with open(path, "rb") as f:
        return mrc.decode(f.read())


def _is_star(path: str) -> bool:
    return path.rstrip("/").endswith(".star")


def _table(spark: SparkSession, s: Settings, path: str) -> DataFrame:
    """The rows of a table with the native pose and position, in STAR tables beside their own columns, written once."""
    if _is_star(path):
        rows = tables.read_star(spark, path)
        native = conversion.native_columns(rows, s.pixel_size, s.size, strict=False)
        names = {"tag", "rlnMicrographName", *"xyz", "dx", "dy", "dz", "tdrot", "tilt", "narot", "averaged", "ref"}
        if "averaged" not in rows.columns:
            native[-2] = F.lit(1.0).alias("averaged")
        rows = rows.select(*native, *(c for c in rows.columns if c not in names))
    else:
        rows = tables.read_tbl(spark, path)
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.col("at") + 1)
    return written(rows.withColumn("tag", whole("tag")).withColumn("ref", whole("ref")), "table")


def _plain(path: str) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def _outermost(folders: list[str]) -> list[str]:
    """The folders that don't lie below another one."""
    kept: list[str] = []
    for f in sorted({f.rstrip("/") or "/" for f in folders}):
        if not any(f == k or f.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(f)
    return kept


def _particles(spark: SparkSession, s: Settings, path: str) -> DataFrame:
    """The rows of a table, each with its volume: that which rlnImageName names, first in the folder of the volumes, then beside
    the table; without names that whose file name spells the row's tag, or by order the i-th row the i-th file, which begin
    again when there are too few. Rows without a file are left out."""
    rows = _table(spark, s, path)
    if "rlnImageName" in rows.columns:
        name, beside = F.col("rlnImageName"), os.path.dirname(path.rstrip("/"))
        parents = rows.where(name.startswith("/")).select(F.regexp_replace(name, "/[^/]*$", "").alias("p")).distinct().collect()  # one row per folder
        folders = _outermost([s.volumes or beside, beside, *(r["p"] for r in parents)])
        below = lambda folder: F.when(~name.startswith("/"), F.concat(F.lit(folder.removeprefix("file://").rstrip("/") + "/"), name))
        candidates = [F.when(name.startswith("/"), name), below(s.volumes or beside), below(beside)]
        files = mrc.listing(spark, folders).select(_plain("path").alias("path"))
        found = conversion.first_existing(rows, candidates, files, "_found")
        return found.join(mrc.read_volumes(spark, folders).withColumn("_found", _plain("path")), "_found")
    volumes = mrc.read_volumes(spark, s.volumes)
    if s.pair_by == "order":
        files = mrc.listing(spark, s.volumes).withColumn("_end", F.col("path").endswith(".mrcs"))
        return cyclic_join(rows, ["src_file", "at"], files, ["_end", "path"]).where("tag is not null").drop("ordinal").join(volumes, "path")
    return rows.join(volumes.withColumn("tag", F.regexp_extract("path", r"([0-9]+)\.mrcs?$", 1).try_cast("bigint")), "tag")


def _rest(rows: DataFrame) -> list[str]:
    """The columns of a table that a search hands on."""
    return [c for c in rows.columns if c not in {*POSE, "ref", *_OF_VOLUME, *_OF_READER} or c == "rlnImageName"]


def _write_average(average, s: Settings, size: float) -> None:
    if average is None:
        raise ValueError("no particles")
    with open(s.output + ".mrc", "wb") as f:
        f.write(mrc.encode(average, size))


def _tomograms(spark: SparkSession, s: Settings) -> DataFrame:
    """A list file, one path or several, as tomo_id, rlnMicrographName, tomo_path."""
    if isinstance(s.tomograms, str) and s.tomograms.endswith(".vll"):
        return tables.read_vll(spark, s.tomograms)
    paths = [s.tomograms] if isinstance(s.tomograms, str) else s.tomograms
    return spark.createDataFrame([(i, os.path.splitext(os.path.basename(p))[0], p) for i, p in enumerate(paths, 1)], "tomo_id bigint, rlnMicrographName string, tomo_path string")


def crop(spark: SparkSession, s: Settings) -> None:
    """Cubes as files in the output folder, and the cropped rows as STAR (output_star, else particles.star in that folder)."""
    s.need("table", "tomograms", "output", "sidelength")
    rows = _table(spark, s, s.table)
    key = next((c for c in ("rlnMicrographName", "rlnTomoName", "tomo") if c in rows.columns), None)
    if key is None:
        raise ValueError("the table names no tomograms")
    listed = _tomograms(spark, s)
    found = conversion.with_names(rows, listed) if key == "tomo" else conversion.with_paths(rows, key, listed)
    found = written(found.where("tomo_path is not null").withColumn("_row", F.monotonically_increasing_id()), "found")
    cubes = written(pipelines.crop(found, s.sidelength, s.fill, key="_row"), "cubes").where("error is null")
    if cubes.isEmpty():
        raise ValueError("no particles were cropped")
    mrc.write_volumes(cubes, s.output)
    named = cubes.select("_row", F.concat(F.lit(s.output.rstrip("/") + "/"), "path").alias("rlnImageName"))
    out = conversion.star_output(found.drop("rlnImageName").join(named, "_row"), not _is_star(s.table), s.pixel_size, s.size)
    tables.write_star(out, s.output_star or s.output.rstrip("/") + "/particles.star", ["rlnImageName"])


def reconstruction(spark: SparkSession, s: Settings) -> None:
    s.need("table", "output")
    done = pipelines.reconstruct(_particles(spark, s, s.table), s.symmetry, s.apply_wedge, list(s.tags) if s.tags else None)
    _write_average(done.average, s, s.pixel_size)


def alignment(spark: SparkSession, s: Settings) -> None:
    """The refined table (output.tbl), the average (output.mrc), and the refined rows as STAR where output_star says."""
    s.need("table", "reference", "output")
    reference, size = _one(s.reference)
    mask = _one(s.mask)[0] > 0 if s.mask else None
    rows = _particles(spark, s, s.table).withColumn("_file", F.col("path"))
    done = pipelines.align(rows, reference, s.search, _rest(rows), s.symmetry, mask)
    good = done.rows.where("error is null")
    tables.write_tbl(good, s.output + ".tbl", "tag")
    if s.output_star:
        named = good if "rlnImageName" in good.columns else good.withColumn("rlnImageName", _plain("_file"))
        tables.write_star(conversion.star_output(named, not _is_star(s.table), s.pixel_size, s.size), s.output_star, ["rlnImageName"])
    _write_average(done.average, s, size)


def classification(spark: SparkSession, s: Settings) -> None:
    """`tables`, one for each reference, take the place of `table`; seeds and particles are those of the first one."""
    s.need("references", "output")
    if s.tables and len(s.tables) != len(s.references):
        raise ValueError(f"{len(s.tables)} tables for {len(s.references)} references")
    path = s.tables[0] if s.tables else s.table
    if not path:
        s.need("table")
    references = {i: _one(p)[0] for i, p in enumerate(s.references, 1)}
    rows = _particles(spark, s, path)
    done = pipelines.classify(rows, references, s.search, _rest(rows), s.iterations, s.output, s.swap, s.symmetry)
    tables.write_tbl(done.rows.where("error is null"), s.output + "/refined", "tag")
    for r, average in done.references.items():
        with open(f"{s.output.removeprefix('file://')}/average_ref_{r:03d}.mrc", "wb") as f:
            f.write(mrc.encode(average, s.pixel_size))


def gen_synthetic(spark: SparkSession, s: Settings) -> None:
    s.need("reference", "output")
    template, size = _one(s.reference)
    rows = pipelines.synthetic(spark, template, s.count, s.seed, s.noise, s.noise_only)
    mrc.write_volumes(rows.select(F.format_string("particle_%012d.mrc", "tag").alias("path"), "nz", "ny", "nx", F.lit(float(size or s.pixel_size)).alias("voxel_size"), "data"), s.output)
    tables.write_tbl(rows.drop("data").withColumn("averaged", F.lit(1.0)), s.output + "/particles.tbl", "tag")


COMMANDS = {f.__name__: f for f in (crop, reconstruction, alignment, classification, gen_synthetic)}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        spark = SparkSession.builder.appName(f"tomoframe {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        with scratch(spark):
            COMMANDS[args[0]](spark, load(args[1]))
    except Exception as e:
        print(json.dumps({"error": str(e)[:2000], "code": type(e).__name__}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
