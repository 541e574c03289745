"""Crop, reconstruction, alignment, classification and synthetic data as Spark jobs."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions import volume as v
from tomoframe.functions.geometry import crop_box
from tomoframe.operators import volumes as ops
from tomoframe.session import file_system, new_folder
from tomoframe.sources import mrc


@dataclass(frozen=True)
class Averaged:
    """rows: one per particle with pose and error; average: the mean volume, None without particles; n: how many it has."""

    rows: DataFrame
    average: np.ndarray | None
    n: int


def _mean(rows: DataFrame, symmetry: str | None) -> tuple[np.ndarray | None, int]:
    best = ops.volume_means(rows, []).orderBy(F.desc("n"), "nz", "ny", "nx").first()
    return (v.symmetrised(ops.box(best), symmetry), best["n"]) if best else (None, 0)


def align(rows: DataFrame, reference: np.ndarray, search: v.Search, keep: list[str], symmetry: str | None = None, mask: np.ndarray | None = None) -> Averaged:
    """Poses of all particles against one reference and their average. The poses and turned volumes are written once."""
    if mask is not None and (mask.shape != reference.shape or not mask.any()):
        raise ValueError("the mask is empty or has another shape than the reference")
    path = new_folder(rows.sparkSession, "aligned")
    ops.aligned(rows, {1: reference}, search, keep, mask=mask).write.parquet(path)
    done = rows.sparkSession.read.parquet(path)
    average, n = _mean(done.where("error is null"), symmetry)
    return Averaged(done, average, n)


def reconstruct(rows: DataFrame, symmetry: str | None = None, wedge: bool = False, tags: list[int] | None = None) -> Averaged:
    """The average of particles with known poses: rows have nz, ny, nx, data, tdrot, tilt, narot, dx, dy, dz, averaged, and tag.

    Only rows with averaged = 1 count (null is 0), and of these the ones whose tag is in `tags`, if given. With `wedge` the
    rows' ftype, ymintilt, ymaxtilt, xmintilt and xmaxtilt say which frequencies of the turned particle are added up.
    """
    used = ops.usable(rows).where(F.coalesce(F.col("averaged"), F.lit(0)) == 1)
    if tags is not None:
        wanted = rows.sparkSession.createDataFrame([(float(t),) for t in dict.fromkeys(tags)], "wanted double")
        used = used.join(wanted, used["tag"].cast("double") == wanted["wanted"], "left_semi")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                back = v.aligned_back(ops.box(r), (r.tdrot, r.tilt, r.narot, r.dx, r.dy, r.dz))
                if wedge:
                    back = v.filtered(back, v.wedge(back.shape, int(r.ftype), float(r.ymintilt), float(r.ymaxtilt), float(r.xmintilt), float(r.xmaxtilt)))
                out.append((*back.shape, back.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["nz", "ny", "nx", "data"])

    turned = used.mapInPandas(run, "nz int, ny int, nx int, data binary")
    average, n = _mean(turned, symmetry)
    return Averaged(used, average, n)


def split_references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Two references to begin with for each shape: the means of the volumes whose own mean is above and not above that of all.
    The most frequent shape has 1 and 2, the next one 3 and 4; a half without volumes has no reference."""
    sizes = ops.statistics(rows, ["nz", "ny", "nx", "data"])
    level = sizes.agg(F.avg("mean")).first()[0]
    if level is None:
        return {}
    means = ops.volume_means(sizes.withColumn("ref", F.when(F.col("mean") > level, 1).otherwise(2)), ["ref"]).collect()
    counts: dict[tuple, int] = {}
    for m in means:
        counts[m["nz"], m["ny"], m["nx"]] = counts.get((m["nz"], m["ny"], m["nx"]), 0) + m["n"]
    order = sorted(counts, key=lambda shape: (-counts[shape], shape))
    return {2 * order.index((m["nz"], m["ny"], m["nx"])) + m["ref"]: ops.box(m) for m in sorted(means, key=lambda m: m["ref"])}


@dataclass(frozen=True)
class Classified:
    rows: DataFrame
    references: dict[int, np.ndarray]
    iterations: int


def _marker(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """Reads or writes a small file beside an iteration's data."""
    fs, at = file_system(spark, path)
    if text is not None:
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    if not fs.exists(at):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def classify(rows: DataFrame, references: dict[int, np.ndarray], search: v.Search, keep: list[str], iterations: int = 3, folder: str | None = None, swap: bool = True, symmetry: str | None = None) -> Classified:
    """Rounds of alignment of every particle to all references (or to its own, without `swap`) and new averages.

    Seeds come from `rows` in every round. A class without particles keeps its reference. Each round is written to
    `folder`, last its marker; a call with the same folder goes on after the last round that is complete.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "classes")
    current, last = dict(references), None
    for i in range(1, iterations + 1):
        at = f"{folder}/ite_{i:03d}"
        done = _marker(spark, f"{at}/checkpoint.json")
        if not done:
            ops.aligned(rows, current, search, keep, own_reference=not swap).write.mode("overwrite").parquet(f"{at}/rows")
        last = spark.read.parquet(f"{at}/rows")
        if not done:
            ops.volume_means(last.where("error is null"), ["ref"]).write.mode("overwrite").parquet(f"{at}/averages")
        new = {m["ref"]: v.symmetrised(ops.box(m), symmetry if i == iterations else None) for m in spark.read.parquet(f"{at}/averages").collect()}
        current = {r: new.get(r, old) for r, old in current.items()}
        if not done:
            counts = last.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.count("error").alias("failed")).first()
            _marker(spark, f"{at}/checkpoint.json", json.dumps({"iteration": i, "max_iterations": iterations, "nref": len(current), "success": counts["ok"], "failed": counts["failed"], "completed": True}))
    return Classified(last, current, iterations)


def crop(particles: DataFrame, side: int, fill: int = -1, path: str = "tomo_path", key: str | None = None) -> DataFrame:
    """Cubes around the 1-based x, y, z of each particle, from the MRC file that `path` names on a folder all executors share.

    Rows are brought together by tomogram, in as many tasks as its rows need, and each task maps the file and reads the
    cubes' bytes only. aligned = 1 or null is cropped. Returns tag, path, nz, ny, nx, voxel_size, data, out_of_scope,
    error, and the row's BIGINT column `key`, if asked for; out-of-scope cubes of fill 1 are left out. Rows without a path have an error.
    """
    keys = [key] if key else []
    if side <= 0 or side % 2:
        raise ValueError("the side must be positive and even")

    def run(batches):
        opened: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                name = f"particle_{int(r.tag):012d}.mrc"
                try:
                    if r.src not in opened:
                        opened.clear()
                        with open(r.src, "rb") as f:
                            h = mrc.header(f.read(mrc.HEADER))
                        opened[r.src] = np.memmap(r.src, h["dtype"], "r", h["start"], h["shape"]), h["voxel_size"]
                    vol, size = opened[r.src]
                    cube, outside = v.cropped(vol, side, (r.z, r.y, r.x), fill)
                except (OSError, ValueError, TypeError) as e:
                    out.append((r.tag, name, None, None, None, None, None, None, str(e), *([r.key_value] if keys else [])))
                    continue
                if cube is not None:
                    out.append((r.tag, name, *cube.shape, size or None, np.asarray(cube, "<f4").tobytes(), outside, None, *([r.key_value] if keys else [])))
            yield pd.DataFrame(out, columns=["tag", "path", "nz", "ny", "nx", "voxel_size", "data", "out_of_scope", "error", *keys])

    rows = particles.where(F.coalesce(F.col("aligned"), F.lit(1)) == 1) if "aligned" in particles.columns else particles
    rows = rows.select(F.col("tag").cast("bigint").alias("tag"), F.col(path).alias("src"), *(F.col(a).cast("double").alias(a) for a in "xyz"), *(F.col(k).alias("key_value") for k in keys))
    spread = rows.repartitionByRange("src", "z", "y", "x").sortWithinPartitions("src", "z", "y", "x")
    return spread.mapInPandas(run, "tag bigint, path string, nz int, ny int, nx int, voxel_size double, data binary, out_of_scope boolean, error string" + "".join(f", {k} bigint" for k in keys))


def crop_plan(particles: DataFrame, side: int, size: tuple[int, int, int]) -> DataFrame:
    """Which cubes are whole, from positions alone."""
    outside = None
    for a, n in zip("xyz", size):
        o = crop_box(F.col(a), side, n)["outside"]
        outside = o if outside is None else outside | o
    return particles.withColumn("out_of_scope", outside)


def synthetic(spark: SparkSession, template: np.ndarray, n: int, seed: int = 42, noise: float = 0.1, noise_only: int = 0) -> DataFrame:
    """`n` posed copies of a template with noise (ref 1), and `noise_only` boxes of noise (ref 2): tag, ref, the pose, nz, ny,
    nx, data. Each row depends on the seed and its own number only, so that tasks may be run again."""
    shared = spark.sparkContext.broadcast(template)

    def run(batches):
        base = shared.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                pose = (*(rng.random(3) * [360, 180, 360]), *rng.integers(-2, 3, 3).astype(float)) if i < n else (0.0,) * 6
                vol = (v.posed(base, pose) if i < n else 0) + rng.normal(0, noise, base.shape)
                out.append((int(i) + 1, 1 if i < n else 2, *pose, *base.shape, vol.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["tag", "ref", "tdrot", "tilt", "narot", "dx", "dy", "dz", "nz", "ny", "nx", "data"])

    return spark.range(n + noise_only).mapInPandas(run, "tag bigint, ref int, tdrot double, tilt double, narot double, dx double, dy double, dz double, nz int, ny int, nx int, data binary")


def positions(spark: SparkSession, n: int, size: tuple[int, int, int], side: int, seed: int = 42) -> DataFrame:
    """`n` particles in a tomogram of `size` (x, y, z): tag, 0-based x, y, z at least half a side from its faces, and angles.
    A row depends on the seed and its number only."""
    u = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "id"), 11) / F.lit(float(2**53))
    at = [(F.lit(side / 2) + u(i) * (s - side)).alias(a) for i, (a, s) in enumerate(zip("xyz", size))]
    return spark.range(n).select((F.col("id") + 1).alias("tag"), *at, (u(3) * 360).alias("tdrot"), F.degrees(F.acos(1 - 2 * u(4))).alias("tilt"), (u(5) * 360).alias("narot"))


def tomogram(particles: DataFrame, template: np.ndarray, size: tuple[int, int, int], noise: float = 1.0, ratio: float = 1.0, slab: int = 32, seed: int = 42) -> DataFrame:
    """A tomogram of `size` (x, y, z) in slabs along z: z0, nz, ny, nx, data. Noise of its own seed fills each slab, and every
    particle that reaches into it is turned and added, scaled so that the template's spread is `ratio` times the noise.

    Slabs are made by one task each from the particles that touch them; no task has the whole tomogram.
    """
    nx, ny, nz = size
    spark = particles.sparkSession
    shared = spark.sparkContext.broadcast(template * (ratio * noise / template.std() if template.std() > 0 else 1.0))
    half = max(template.shape)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("z") - half) / slab).cast("int")), F.least(F.lit((nz - 1) // slab), F.floor((F.col("z") + half) / slab).cast("int")))
    names = ["tag", "x", "y", "z", "tdrot", "tilt", "narot"]
    placed = particles.select(F.explode(near).alias("slab"), *(F.col(c).cast("double").alias(c) for c in names))
    all_slabs = spark.range(-(-nz // slab)).select(F.col("id").cast("int").alias("slab"), *(F.lit(None).cast("double").alias(c) for c in names))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["slab"].iloc[0])
        height = min(slab, nz - k * slab)
        vol = np.random.default_rng([seed, k]).normal(0, noise, (height, ny, nx)).astype(np.float32)
        for r in pdf.dropna(subset=["tag"]).sort_values("tag").itertuples():
            v.embed(vol, v.turned(shared.value, v.rotation(r.tdrot, r.tilt, r.narot)), (np.rint(r.z) - k * slab, r.y, r.x))
        return pd.DataFrame([(k * slab, height, ny, nx, vol.astype("<f4").tobytes())], columns=["z0", "nz", "ny", "nx", "data"])

    return placed.unionByName(all_slabs).groupBy("slab").applyInPandas(build, "z0 int, nz int, ny int, nx int, data binary")


def write_tomogram(slabs: DataFrame, path: str, size: tuple[int, int, int], voxel_size: float = 0.0) -> None:
    """Slabs into one MRC file on a folder that all executors share; each task writes the bytes of its own slabs."""
    nx, ny, nz = size
    with open(path, "wb") as f:
        head = bytearray(mrc.encode(np.zeros((1, 1, 1), np.float32), voxel_size)[: mrc.HEADER])
        head[0:12] = np.array([nx, ny, nz], "<i4").tobytes()
        head[28:40] = np.array([nx, ny, nz], "<i4").tobytes()
        head[40:52] = (np.array([nx, ny, nz], "<f4") * np.float32(voxel_size)).tobytes()
        f.write(head)
        f.truncate(mrc.HEADER + 4 * nx * ny * nz)

    def run(rows) -> None:
        with open(path, "r+b") as f:
            for r in rows:
                f.seek(mrc.HEADER + 4 * r["z0"] * ny * nx)
                f.write(r["data"])

    slabs.foreachPartition(run)


def write_rows_json(rows: DataFrame, folder: str) -> None:
    """The rows of an iteration as JSON lines, in one folder for each reference."""
    rows.drop("data").write.mode("overwrite").partitionBy("ref").json(folder)
