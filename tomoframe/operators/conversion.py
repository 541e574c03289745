"""Native particle rows as STAR rows and back; paths and names of tomograms and particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions import geometry as g
from tomoframe.functions.columns import number, whole
from tomoframe.session import broadcast_if_small
from tomoframe.schema import STAR_OUTPUT
from tomoframe.sources import tables

AXES = "xyz"


def need_columns(rows: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def to_star(rows: DataFrame, pixel: float | None = None, size: tuple[float, float, float] | None = None, centred: bool = True, transposed: bool = False, more: list[str] = ()) -> DataFrame:
    """STAR columns of native rows: coordinates (centred Angstrom, or voxels as they are), ZYZ angles, origins (0 without a
    pixel size), `more` as it is, rlnMicrographName (the column of that name, else the id cut to a whole), tag. Nulls and NaN give nulls."""
    need_columns(rows, [*AXES, "tdrot", "tilt", "narot", "dx", "dy", "dz"])
    if centred and (pixel is None or size is None):
        raise ValueError("centred coordinates need a pixel size and a tomogram size")
    rot, tilt, psi = g.zxz_to_zyz(number("tdrot"), number("tilt"), number("narot"), transposed)
    out = []
    for i, a in enumerate(AXES):
        out.append(g.to_centred(number(a), size[i], pixel).alias(f"rlnCenteredCoordinate{a.upper()}Angst") if centred else number(a).alias(f"rlnCoordinate{a.upper()}"))
        out.append((-number(f"d{a}") * F.lit(pixel if pixel is not None else 0.0) + F.lit(0.0)).alias(f"rlnOrigin{a.upper()}Angst"))
    if "rlnMicrographName" in rows.columns:
        name = F.col("rlnMicrographName")
    elif "tomo" in rows.columns:
        name = F.when(F.abs(number("tomo")) < 9e18, number("tomo")).cast("bigint").cast("string")
    else:
        name = F.lit("1")
    tag = [whole("tag").alias("tag")] if "tag" in rows.columns else []
    return rows.select(*tag, *more, name.alias("rlnMicrographName"), *out, rot.alias("rlnAngleRot"), tilt.alias("rlnAngleTilt"), psi.alias("rlnAnglePsi"))


def native_columns(rows: DataFrame, pixel: float | None = None, size: tuple[float, float, float] | None = None, transposed: bool = False, strict: bool = True) -> list[Column]:
    """Native columns of STAR rows; centred coordinates need a pixel size, origins too (else they are 0). The tomogram size is that
    given, else size_x, size_y, size_z of the row, as read_star has them; without either the centre is 0. averaged is 0 and
    ref 1 where STAR has none. If not `strict`, angles and coordinates that the table doesn't have are 0."""
    angles = ["rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi"]
    if strict or all(a in rows.columns for a in angles):
        need_columns(rows, angles)
        tdrot, tilt, narot = g.zyz_to_zxz(*(number(a) for a in angles), transposed)
    else:
        tdrot = tilt = narot = F.lit(0.0)

    def position(i: int, a: str) -> Column:
        if f"rlnCoordinate{a.upper()}" in rows.columns:
            return number(f"rlnCoordinate{a.upper()}")
        if f"rlnCenteredCoordinate{a.upper()}Angst" not in rows.columns:
            if strict:
                need_columns(rows, [a])
            return number(a) if a in rows.columns else F.lit(0.0)
        if pixel is None:
            raise ValueError("centred coordinates need a pixel size")
        own = F.coalesce(number(f"size_{a}"), F.lit(0.0)) if f"size_{a}" in rows.columns else F.lit(0.0)
        return g.from_centred(number(f"rlnCenteredCoordinate{a.upper()}Angst"), own if size is None else size[i], pixel)

    def shift(a: str) -> Column:
        name = f"rlnOrigin{a.upper()}Angst"
        return F.coalesce(-number(name) / pixel, F.lit(0.0)) + F.lit(0.0) if pixel and name in rows.columns else F.lit(0.0)

    given = lambda n, default: F.coalesce(number(n), F.lit(default)) if n in rows.columns else F.lit(default)
    tag = [number("tag").alias("tag")] if "tag" in rows.columns else []
    name = ["rlnMicrographName"] if "rlnMicrographName" in rows.columns else []
    return [*tag, *name, *(position(i, a).alias(a) for i, a in enumerate(AXES)), *(shift(a).alias(f"d{a}") for a in AXES), tdrot.alias("tdrot"), tilt.alias("tilt"), narot.alias("narot"), given("averaged", 0.0).alias("averaged"), given("ref", 1.0).alias("ref")]


def from_star(rows: DataFrame, pixel: float | None = None, size: tuple[float, float, float] | None = None, transposed: bool = False) -> DataFrame:
    """The native columns of STAR rows; see native_columns."""
    return rows.select(*native_columns(rows, pixel, size, transposed))


def star_output(rows: DataFrame, from_native: bool, pixel: float, size: tuple[float, float, float] | None = None) -> DataFrame:
    """The STAR columns that are written of rows with the native pose columns and rlnImageName. STAR tables keep their own columns, with
    the angles and origins of the pose; native ones are converted, with centred coordinates if the tomogram size is known."""
    if from_native:
        made = to_star(rows, pixel, size, centred=size is not None, more=["rlnImageName"])
    else:
        angles = dict(zip(("rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi"), g.zxz_to_zyz(number("tdrot"), number("tilt"), number("narot"))))
        made = rows.withColumns(angles | {f"rlnOrigin{a.upper()}Angst": -number(f"d{a}") * pixel + F.lit(0.0) for a in AXES})
    if "tag" in made.columns and "rlnTomoParticleId" not in made.columns:
        made = made.withColumn("rlnTomoParticleId", whole("tag"))
    return made.select(*(c for c in STAR_OUTPUT if c in made.columns))


def with_names(rows: DataFrame, tomograms: DataFrame) -> DataFrame:
    """rlnMicrographName and tomo_path by the nearest whole tomo from a list (tomo_id, rlnMicrographName, tomo_path); without
    one the name is the id cut to a whole, and the path null."""
    keyed = rows.withColumn("_tomo", whole("tomo"))
    listed = broadcast_if_small(tomograms.select(F.col("tomo_id").alias("_tomo"), F.col("rlnMicrographName").alias("_name"), "tomo_path").dropDuplicates(["_tomo"]), cheap=True)
    spelled = F.when(F.abs(number("tomo")) < 9e18, number("tomo")).cast("bigint").cast("string")
    return keyed.join(listed, "_tomo", "left").withColumn("rlnMicrographName", F.coalesce("_name", spelled)).drop("_tomo", "_name")


def with_paths(rows: DataFrame, name: str, tomograms: DataFrame) -> DataFrame:
    """`rows` with tomo_path from a list (tomo_id, rlnMicrographName, tomo_path): that of the equal name, of several the first
    in the list, else of the id that the column `name` is or spells; null if the list has neither."""
    by_name = tomograms.groupBy(F.col("rlnMicrographName").alias("_name")).agg(F.min_by("tomo_path", "tomo_id").alias("_by_name"))
    by_id = tomograms.groupBy(F.col("tomo_id").alias("_id")).agg(F.first("tomo_path").alias("_by_id"))
    spelled = F.trim(F.col(name).cast("string"))
    keyed = rows.drop("tomo_path").withColumns({"_name": spelled, "_id": whole(spelled.try_cast("double"))})
    found = keyed.join(broadcast_if_small(by_name), "_name", "left").join(broadcast_if_small(by_id), "_id", "left")
    return found.withColumn("tomo_path", F.coalesce("_by_name", "_by_id")).drop("_name", "_id", "_by_name", "_by_id")


def tbl_to_star(spark: SparkSession, tbl: str, vll: str | None, out: str, pixel: float | None = None, size: tuple[float, float, float] | None = None, centred: bool = True) -> None:
    """A native table and its tomogram list as STAR files."""
    rows = tables.read_tbl(spark, tbl)
    if vll:
        rows = with_names(rows, tables.read_vll(spark, vll))
    tables.write_star(to_star(rows, pixel, size, centred), out, ["tag"])


def first_existing(rows: DataFrame, candidates: list[Column], listing: DataFrame, name: str = "found") -> DataFrame:
    """`rows` with the first of the candidate paths that `listing` (path) has, in the order given; null if it has none.

    The candidates are exploded and looked up in one join, so that the listing is read once."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    tried = keyed.select("_row", F.posexplode(F.array(*candidates)).alias("_i", "path")).where("path is not null")
    hits = tried.join(listing.select("path").distinct(), "path").groupBy("_row").agg(F.min_by("path", "_i").alias(name))
    return keyed.join(hits, "_row", "left").drop("_row")
