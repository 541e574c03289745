"""The operators of particle tables, one query each over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions import geometry as g
from tomoframe.functions.columns import number, trimmed, whole
from tomoframe.functions.formatting import general_format, hms
from tomoframe.operators.conversion import first_existing
from tomoframe.operators.ordered import in_order
from tomoframe.operators.ordinals import cyclic_join, first_seen_ids, with_ordinal
from tomoframe.plans.registry import Registry, rounded
from tomoframe.schema import STAR_OUTPUT, TBL_COLUMNS
from tomoframe.session import table
from tomoframe.sources.tables import token_columns

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
query = R.query
c = F.col

PIXEL, SIDE = 4.284, 32
TOMO_SIZE = (960, 928, 400)


@query("SELECT row_id FROM dynamo_tbl WHERE coalesce(aligned, 1) = 1")
def filter_default_true(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").where(F.coalesce(number("aligned"), F.lit(1.0)) == 1).select("row_id")


@query("SELECT row_id FROM dynamo_tbl WHERE coalesce(averaged, 0) = 1")
def filter_default_false(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").where(F.coalesce(number("averaged"), F.lit(0.0)) == 1).select("row_id")


@query("SELECT row_id, tag, ref FROM dynamo_tbl WHERE ref IN (2, 3, 5, 8, 13, 21, 34)")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").where(c("ref").isin(2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0)).select("row_id", "tag", "ref")


@query('SELECT star_id, "rlnImageName", "rlnMicrographName", "rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi", "rlnOriginXAngst", "rlnOriginYAngst", "rlnOriginZAngst", tag, averaged, ref FROM star_particles')
def project_whitelist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "star_particles")
    return rows.select("star_id", *(x for x in [*STAR_OUTPUT, "tag", "averaged", "ref"] if x in rows.columns))


_FIRST_ENTRY = """SELECT tomo_id, min_by("rlnMicrographName", entry_id) AS name, min_by(tomo_path, entry_id) AS path FROM vll WHERE tomo_path IS NOT NULL GROUP BY 1"""


def _first_entries(spark: SparkSession, d: str) -> DataFrame:
    """The first entry with a path of each tomogram."""
    return table(spark, d, "vll").where("tomo_path is not null").groupBy("tomo_id").agg(F.min_by("rlnMicrographName", "entry_id").alias("name"), F.min_by("tomo_path", "entry_id").alias("path"))


@query(f"SELECT row_id, coalesce(name, CAST(CAST(trunc(tomo) AS BIGINT) AS VARCHAR)) AS micrograph FROM dynamo_tbl LEFT JOIN ({_FIRST_ENTRY}) ON CAST(round(tomo) AS BIGINT) = tomo_id")
def lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The name is looked up by the nearest whole id, the fallback spells the id cut to a whole."""
    rows = table(spark, d, "dynamo_tbl").select("row_id", whole("tomo").alias("tomo_id"), F.when(F.abs(number("tomo")) < 9e18, c("tomo")).cast("bigint").cast("string").alias("spelled"))
    return rows.join(_first_entries(spark, d), "tomo_id", "left").select("row_id", F.coalesce("name", "spelled").alias("micrograph"))


@query(rf"""
WITH s AS (SELECT star_id, trim("rlnMicrographName", e' \t\r\n') AS name FROM star_particles),
e AS ({_FIRST_ENTRY}),
by_name AS (SELECT "rlnMicrographName" AS name, min_by(tomo_path, entry_id) AS path FROM vll WHERE tomo_path IS NOT NULL GROUP BY 1)
SELECT star_id, coalesce(b.path, e.path) AS path FROM s LEFT JOIN by_name b ON s.name = b.name
LEFT JOIN e ON regexp_full_match(s.name, '[0-9]{{1,18}}') AND CAST(TRY_CAST(s.name AS BIGINT) AS BIGINT) = e.tomo_id""")
def lookup_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The path of a name, else of the id that the name spells; of several entries the first."""
    by_name = table(spark, d, "vll").where("tomo_path is not null").groupBy(c("rlnMicrographName").alias("name")).agg(F.min_by("tomo_path", "entry_id").alias("by_name"))
    name = trimmed("rlnMicrographName")
    rows = table(spark, d, "star_particles").select("star_id", name.alias("name"), F.when(name.rlike(r"^[0-9]{1,18}\z"), name.try_cast("bigint")).alias("tomo_id"))
    return rows.join(by_name, "name", "left").join(_first_entries(spark, d).select("tomo_id", c("path").alias("by_id")), "tomo_id", "left").select("star_id", F.coalesce("by_name", "by_id").alias("path"))


@query(f"SELECT row_id, path FROM dynamo_tbl JOIN ({_FIRST_ENTRY}) ON CAST(round(tomo) AS BIGINT) = tomo_id")
def lookup_drop_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").select("row_id", whole("tomo").alias("tomo_id")).join(_first_entries(spark, d), "tomo_id").select("row_id", "path")


@query(r"SELECT entry_id FROM vll WHERE trim(tomo_path, e' \t\r\n') IN (SELECT path FROM tomo_volumes)")
def semi_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vll").select("entry_id", trimmed("tomo_path").alias("path")).join(table(spark, d, "tomo_volumes").select("path"), "path", "left_semi").select("entry_id")


@query(r"""
WITH c AS (SELECT entry_id, trim(tomo_path, e' \t\r\n') AS p FROM vll), l AS (SELECT DISTINCT path FROM tomo_volumes)
SELECT entry_id, coalesce(a.path, b.path, d.path) AS found FROM c LEFT JOIN l a ON a.path = CASE WHEN p <> '' THEN p END
LEFT JOIN l b ON b.path = regexp_replace(p, '\.rec$', '.mrc') LEFT JOIN l d ON d.path = regexp_replace(p, '/v[0-9]+/', '/')""")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first of several places of a tomogram that exists: as listed, with the other ending, without the version folder."""
    path = trimmed("tomo_path")
    candidates = [path, F.regexp_replace(path, r"\.rec$", ".mrc"), F.regexp_replace(path, "/v[0-9]+/", "/")]
    return first_existing(table(spark, d, "vll").select("entry_id", "tomo_path"), candidates, table(spark, d, "tomo_volumes")).select("entry_id", "found")


@query("""
WITH p AS (SELECT star_id, row_number() OVER (ORDER BY star_id) - 1 AS i FROM star_particles),
v AS (SELECT path, row_number() OVER (ORDER BY path, created_at, voxel_size NULLS FIRST, nz) - 1 AS j FROM (SELECT path, created_at, voxel_size, nz FROM tomo_volumes))
SELECT star_id, path FROM p JOIN v ON p.i % (SELECT count(*) FROM v) = v.j""")
def positional_cyclic_join(spark: SparkSession, d: str) -> DataFrame:
    volumes = table(spark, d, "tomo_volumes").select("path", "created_at", "voxel_size", "nz")
    return cyclic_join(table(spark, d, "star_particles").select("star_id"), ["star_id"], volumes, ["path", "created_at", "voxel_size", "nz"]).select("star_id", "path")


@query("SELECT CAST(i % 3 AS BIGINT) AS worker, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i FROM dynamo_tbl) GROUP BY 1")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = with_ordinal(table(spark, d, "dynamo_tbl").select("row_id"), ["row_id"])
    return rows.groupBy(F.pmod("ordinal", F.lit(3)).cast("bigint").alias("worker")).agg(F.count("*").alias("n"), F.sum("row_id").alias("id_sum"))


@query("SELECT star_id, tag, row_number() OVER (ORDER BY star_id) - 1 AS row_idx FROM star_particles")
def ordered_output(spark: SparkSession, d: str) -> DataFrame:
    return with_ordinal(table(spark, d, "star_particles").select("star_id", "tag"), ["star_id"], "row_idx")


@query("""SELECT m AS micrograph, row_number() OVER (ORDER BY f, m) AS id FROM (SELECT "rlnMicrographName" AS m, min(star_id) AS f FROM star_particles WHERE "rlnMicrographName" IS NOT NULL GROUP BY 1)""")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return first_seen_ids(table(spark, d, "star_particles").select(c("rlnMicrographName").alias("micrograph"), "star_id"), "micrograph", "star_id").select("micrograph", "id")


@query("""
WITH l AS (SELECT path, 1 AS kind FROM tomo_volumes WHERE path LIKE '%.mrc' UNION ALL SELECT path, 2 FROM tomo_volumes WHERE path LIKE '%.rec')
SELECT path, row_number() OVER (ORDER BY kind, path) - 1 AS place FROM l""")
def glob_union(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "tomo_volumes").select("path")
    kinds = [paths.where(c("path").endswith(end)).withColumn("kind", F.lit(i)) for i, end in enumerate((".mrc", ".rec"), 1)]
    return with_ordinal(kinds[0].unionByName(kinds[1]), ["kind", "path"], "place").select("path", "place")


@query("""
SELECT star_id, tag AS tag, 1 AS ref, x, y, z FROM star_particles WHERE averaged = 1
UNION ALL SELECT star_id, tag + (SELECT max(tag) FROM star_particles), 2, 0.0, 0.0, 0.0 FROM star_particles WHERE averaged = 0""")
def union_real_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "star_particles")
    highest = rows.agg(F.max("tag")).first()[0]
    noise = rows.where("averaged = 0").select("star_id", (c("tag") + F.lit(highest)).alias("tag"), F.lit(2).alias("ref"), *(F.lit(0.0).alias(a) for a in "xyz"))
    return rows.where("averaged = 1").select("star_id", "tag", F.lit(1).alias("ref"), *"xyz").unionByName(noise)


@query("""
SELECT CAST(round(tomo) AS BIGINT) AS tomo, row_id, cc FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(round(tomo) AS BIGINT) ORDER BY cc DESC, row_id) AS k FROM dynamo_tbl WHERE tomo IS NOT NULL AND cc IS NOT NULL AND NOT isnan(cc)
) WHERE k = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each tomogram; the first row wins a tie, NaN never wins."""
    rows = table(spark, d, "dynamo_tbl").select(whole("tomo").alias("tomo"), "row_id", (number("cc") + 0.0).alias("cc")).where("tomo is not null and cc is not null")
    return rows.groupBy("tomo").agg(F.max(F.struct("cc", (-c("row_id")).alias("first"))).alias("best")).select("tomo", (-c("best.first")).alias("row_id"), "best.cc")


@query("SELECT CAST(ref AS BIGINT) AS ref, count(*) AS n FROM dynamo_tbl WHERE ref IS NOT NULL GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").groupBy(whole("ref").alias("ref")).agg(F.count("*").alias("n")).where("ref is not null")


@query("SELECT CAST(round(tomo) AS BIGINT) AS tomo, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row, count(DISTINCT tag) AS n_tags FROM dynamo_tbl WHERE tomo IS NOT NULL GROUP BY 1")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each tomogram, as crops are grouped so that each tomogram is opened once."""
    rows = table(spark, d, "dynamo_tbl").select(whole("tomo").alias("tomo"), "row_id", "tag").where("tomo is not null")
    return rows.groupBy("tomo").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.countDistinct("tag").alias("n_tags"))


GROUP_BLOCK = 1000


@query(f"""
WITH r AS (SELECT CAST(round(tomo) AS BIGINT) AS tomo, row_id, row_number() OVER (PARTITION BY CAST(round(tomo) AS BIGINT) ORDER BY row_id) - 1 AS i FROM dynamo_tbl WHERE tomo IS NOT NULL AND NOT isnan(tomo))
SELECT tomo, i // {GROUP_BLOCK} AS block, list(row_id ORDER BY row_id) AS rows FROM r GROUP BY 1, 2""")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each tomogram in order, as one list per block of at most GROUP_BLOCK rows, so that a tomogram with very many
    rows is many lists and no task has them all."""
    rows = table(spark, d, "dynamo_tbl").select(whole("tomo").alias("tomo"), "row_id").where("tomo is not null")
    blocks = in_order(rows, ["tomo"], ["row_id"]).withColumn("block", F.floor((c("place") - 1) / GROUP_BLOCK).cast("bigint"))
    return blocks.groupBy("tomo", "block").agg(F.array_sort(F.collect_list("row_id")).alias("rows"))


@query("""
WITH parts AS (SELECT CAST(ref AS BIGINT) AS ref, row_id // 1000 AS chunk, sum(CASE WHEN NOT isnan(cc) THEN CAST(cc AS DECIMAL(20, 8)) END) AS s, count(CASE WHEN NOT isnan(cc) THEN cc END) AS n FROM dynamo_tbl WHERE ref IS NOT NULL GROUP BY 1, 2)
SELECT ref, round(CAST(sum(s) AS DOUBLE), 6) AS cc_sum, CAST(sum(n) AS BIGINT) AS n, count(*) AS chunks FROM parts GROUP BY 1""")
def chunked_partial_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums by chunk of rows, then over the chunks."""
    rows = table(spark, d, "dynamo_tbl").select(whole("ref").alias("ref"), F.expr("row_id div 1000").alias("chunk"), number("cc").cast("decimal(20,8)").alias("cc")).where("ref is not null")
    parts = rows.groupBy("ref", "chunk").agg(F.sum("cc").alias("s"), F.count("cc").alias("n"))
    return parts.groupBy("ref").agg(F.round(F.sum("s").cast("double"), 6).alias("cc_sum"), F.sum("n").alias("n"), F.count("*").alias("chunks"))


@query("""
SELECT CASE WHEN data IS NULL THEN 'no data' WHEN nz * ny * nx * 4 <> octet_length(data) THEN 'size' WHEN voxel_size IS NULL THEN 'no voxel size' ELSE 'ok' END AS state, count(*) AS n FROM tomo_volumes GROUP BY 1""")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Volumes that can be used, and the others by reason."""
    state = F.when(c("data").isNull(), "no data").when(c("nz") * c("ny") * c("nx") * 4 != F.octet_length("data"), "size").when(c("voxel_size").isNull(), "no voxel size").otherwise("ok")
    return table(spark, d, "tomo_volumes").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT path, created_at FROM tomo_volumes WHERE data IS NOT NULL AND octet_length(data) = 192 AND (nz, ny, nx) = (3, 4, 4)")
def shape_guard(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of the expected shape; headers are compared before any data is decoded."""
    return table(spark, d, "tomo_volumes").where("nz = 3 and ny = 4 and nx = 4 and octet_length(data) = 192").select("path", "created_at")


_AXES = "".join(f", round(({a} - {s} / 2.0) * {PIXEL}, 6) + 0.0 AS centred_{a}, round(-d{a} * {PIXEL}, 6) + 0.0 AS origin_{a}" for a, s in zip("xyz", TOMO_SIZE))
_WRAP = "CASE WHEN ({x}) - 360 * floor(({x}) / 360) > 180 THEN ({x}) - 360 * floor(({x}) / 360) - 360 ELSE ({x}) - 360 * floor(({x}) / 360) END"


@query(f"SELECT row_id{_AXES}, round({_WRAP.format(x='tdrot - 90')}, 6) + 0.0 AS rot, tilt, round({_WRAP.format(x='narot + 90')}, 6) + 0.0 AS psi FROM dynamo_tbl")
def to_star(spark: SparkSession, d: str) -> DataFrame:
    """Native rows as STAR rows: centred Angstrom, ZYZ angles, origins."""
    rot, tilt, psi = g.zxz_to_zyz(c("tdrot"), c("tilt"), c("narot"))
    axes = [e for a, s in zip("xyz", TOMO_SIZE) for e in (rounded(g.to_centred(c(a), s, PIXEL)).alias(f"centred_{a}"), rounded(-c(f"d{a}") * PIXEL).alias(f"origin_{a}"))]
    return table(spark, d, "dynamo_tbl").select("row_id", *axes, rounded(rot).alias("rot"), tilt.alias("tilt"), rounded(psi).alias("psi"))


@query(
    "SELECT star_id, tag, x, y, z"
    + "".join(f', round(-"rlnOrigin{a.upper()}Angst" / {PIXEL}, 6) + 0.0 AS d{a}' for a in "xyz")
    + f""", round({_WRAP.format(x='"rlnAngleRot" + 90')}, 6) + 0.0 AS tdrot, "rlnAngleTilt" AS tilt, round({_WRAP.format(x='"rlnAnglePsi" - 90')}, 6) + 0.0 AS narot FROM star_particles"""
)
def from_star(spark: SparkSession, d: str) -> DataFrame:
    tdrot, tilt, narot = g.zyz_to_zxz(c("rlnAngleRot"), c("rlnAngleTilt"), c("rlnAnglePsi"))
    shifts = [rounded(-c(f"rlnOrigin{a.upper()}Angst") / PIXEL).alias(f"d{a}") for a in "xyz"]
    return table(spark, d, "star_particles").select("star_id", "tag", *"xyz", *shifts, rounded(tdrot).alias("tdrot"), tilt.alias("tilt"), rounded(narot).alias("narot"))


@query("SELECT star_id" + "".join(f", round((({a} - {s} / 2.0) * {PIXEL}) / {PIXEL} + {s} / 2.0, 6) + 0.0 AS {a}" for a, s in zip("xyz", TOMO_SIZE)) + " FROM star_particles")
def centered_to_abs(spark: SparkSession, d: str) -> DataFrame:
    """There and back again: centred Angstrom as absolute voxels."""
    return table(spark, d, "star_particles").select("star_id", *(rounded(g.from_centred(g.to_centred(c(a), s, PIXEL), s, PIXEL)).alias(a) for a, s in zip("xyz", TOMO_SIZE)))


@query(f"SELECT row_id, round({_WRAP.format(x='90 - narot')}, 6) + 0.0 AS rot, tilt, round({_WRAP.format(x='-90 - tdrot')}, 6) + 0.0 AS psi FROM dynamo_tbl")
def euler_convert(spark: SparkSession, d: str) -> DataFrame:
    """ZXZ to the ZYZ angles of the transposed matrix; the form for the same matrix is in to_star."""
    rot, tilt, psi = g.zxz_to_zyz(c("tdrot"), c("tilt"), c("narot"), transposed=True)
    return table(spark, d, "dynamo_tbl").select("row_id", rounded(rot).alias("rot"), tilt.alias("tilt"), rounded(psi).alias("psi"))


def _sql_matrix(a: str, b: str, n: str) -> list[list[str]]:
    """Closed form of Rz(a) Rx(b) Rz(n)."""
    ca, sa, cb, sb, cn, sn = (f"{f}(radians({x}))" for x in (a, b, n) for f in ("cos", "sin"))
    return [
        [f"({ca}*{cn} - {sa}*{cb}*{sn})", f"(-{ca}*{sn} - {sa}*{cb}*{cn})", f"({sa}*{sb})"],
        [f"({sa}*{cn} + {ca}*{cb}*{sn})", f"(-{sa}*{sn} + {ca}*{cb}*{cn})", f"(-{ca}*{sb})"],
        [f"({sb}*{sn})", f"({sb}*{cn})", f"({cb})"],
    ]


@query("SELECT row_id, " + ", ".join(f"round({e}, 6) + 0.0 AS m{i}{j}" for i, row in enumerate(_sql_matrix("tdrot", "tilt", "narot")) for j, e in enumerate(row)) + " FROM dynamo_tbl")
def euler_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = g.zxz_matrix(c("tdrot"), c("tilt"), c("narot"))
    return table(spark, d, "dynamo_tbl").select("row_id", *(rounded(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


_TURN = _sql_matrix("30.0", "20.0", "15.0")
_OWN = _sql_matrix("tdrot", "tilt", "narot")
_BOTH = [["(" + " + ".join(f"{_OWN[i][k]}*{_TURN[k][j]}" for k in range(3)) + ")" for j in range(3)] for i in range(3)]


@query(
    "SELECT row_id, round(degrees(acos(greatest(-1.0, least(1.0, m22)))), 4) AS tilt, round(cos(atan2(m02, -m12)), 4) + 0.0 AS cos_tdrot, round(cos(atan2(m20, m21)), 4) + 0.0 AS cos_narot FROM (SELECT row_id, "
    + ", ".join(f"{_BOTH[i][j]} AS m{i}{j}" for i, j in ((2, 2), (0, 2), (1, 2), (2, 0), (2, 1)))
    + " FROM dynamo_tbl WHERE tdrot IS NOT NULL AND tilt IS NOT NULL AND narot IS NOT NULL) WHERE abs(m22) < 0.999999"
)
def euler_compose(spark: SparkSession, d: str) -> DataFrame:
    """Each pose followed by one fixed turn, as ZXZ angles."""
    turn = tuple(F.lit(x) for x in (30.0, 20.0, 15.0))
    rows = table(spark, d, "dynamo_tbl").where(c("tdrot").isNotNull() & c("tilt").isNotNull() & c("narot").isNotNull())
    tdrot, tilt, narot = g.composed((c("tdrot"), c("tilt"), c("narot")), turn)
    out = rows.select("row_id", tdrot.alias("a"), tilt.alias("b"), narot.alias("n")).where(F.abs(F.cos(F.radians("b"))) < 0.999999)
    return out.select("row_id", F.round("b", 4).alias("tilt"), rounded(F.cos(F.radians("a")), 4).alias("cos_tdrot"), rounded(F.cos(F.radians("n")), 4).alias("cos_narot"))


_POLE = "abs(m22) > 1 - 1e-9"
_TDROT, _NAROT = f"CASE WHEN {_POLE} THEN atan2(m10, m00) ELSE atan2(m02, -m12) END", f"CASE WHEN {_POLE} THEN 0.0 ELSE atan2(m20, m21) END"


@query(
    "SELECT row_id, round(CASE WHEN m22 IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, m22)))) END, 4) AS tilt, "
    + ", ".join(f"round({f}({e}), 4) + 0.0 AS {f}_{name}" for name, e in (("tdrot", _TDROT), ("narot", _NAROT)) for f in ("cos", "sin"))
    + " FROM (SELECT row_id, "
    + ", ".join(f"{_BOTH[i][j]} AS m{i}{j}" for i, j in ((2, 2), (0, 2), (1, 2), (2, 0), (2, 1), (0, 0), (1, 0)))
    + " FROM dynamo_tbl)"
)
def euler_compose_all(spark: SparkSession, d: str) -> DataFrame:
    """As euler_compose, for every row: at a pole narot is 0, an angle that depends on a null is null, and the sine tells an
    angle from its negative."""
    turn = tuple(F.lit(x) for x in (30.0, 20.0, 15.0))
    tdrot, tilt, narot = g.composed((c("tdrot"), c("tilt"), c("narot")), turn)
    out = table(spark, d, "dynamo_tbl").select("row_id", tdrot.alias("a"), tilt.alias("b"), narot.alias("n"))
    parts = [rounded(f(F.radians(x)), 4).alias(f"{k}_{name}") for name, x in (("tdrot", "a"), ("narot", "n")) for k, f in (("cos", F.cos), ("sin", F.sin))]
    return out.select("row_id", F.round("b", 4).alias("tilt"), *parts)


_CROP = "".join(f", CAST(ceil(greatest(1.0, floor({a}) - {SIDE / 2})) AS BIGINT) AS {a}_lo, CAST(floor(least({s}.0, floor({a}) + {SIDE / 2} - 1)) AS BIGINT) AS {a}_hi" for a, s in zip("xyz", TOMO_SIZE))
_OUT = " OR ".join(f"floor({a}) - {SIDE / 2} < 1 OR floor({a}) + {SIDE / 2} - 1 > {s}" for a, s in zip("xyz", TOMO_SIZE))


@query(f"SELECT row_id{_CROP}, ({_OUT}) AS out_of_scope FROM dynamo_tbl WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The part of the tomogram that a crop reads, found before any data is read."""
    boxes = {a: g.crop_box(c(a), SIDE, s) for a, s in zip("xyz", TOMO_SIZE)}
    bounds = [e.cast("bigint").alias(f"{a}_{k}") for a, b in boxes.items() for k, e in b.items() if k in ("lo", "hi")]
    rows = table(spark, d, "dynamo_tbl").where("x is not null and y is not null and z is not null")
    return rows.select("row_id", *bounds, (boxes["x"]["outside"] | boxes["y"]["outside"] | boxes["z"]["outside"]).alias("out_of_scope"))


_EMBED = "".join(
    f", greatest(0, CAST(round_even({a}, 0) AS BIGINT) - {SIDE // 2}) AS {a}_lo, least({s}, CAST(round_even({a}, 0) AS BIGINT) - {SIDE // 2} + {SIDE}) AS {a}_hi" for a, s in zip("xyz", TOMO_SIZE)
)


@query(f"SELECT star_id{_EMBED} FROM star_particles")
def embed_bounds(spark: SparkSession, d: str) -> DataFrame:
    boxes = {a: g.embed_box(c(a), SIDE, s) for a, s in zip("xyz", TOMO_SIZE)}
    return table(spark, d, "star_particles").select("star_id", *(b[k].alias(f"{a}_{k}") for a, b in boxes.items() for k in ("lo", "hi")))


@query("SELECT row_id, greatest(0.0, least(360.0, CASE WHEN ymintilt = 0 THEN ymaxtilt ELSE abs(ymaxtilt - ymintilt) END)) AS width FROM dynamo_tbl WHERE ymintilt IS NOT NULL AND ymaxtilt IS NOT NULL")
def aperture(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dynamo_tbl").where("ymintilt is not null and ymaxtilt is not null")
    return rows.select("row_id", g.aperture(c("ymintilt"), c("ymaxtilt")).alias("width"))


_LO, _HI = (f"(({x}) - 360 * floor(({x}) / 360))" for x in ("tdrot - 15", "tdrot + 16"))


@query(f"SELECT row_id, round(CASE WHEN {_LO} > {_HI} THEN 0 ELSE {_LO} END, 6) + 0.0 AS lo, round(CASE WHEN {_LO} > {_HI} THEN 360 ELSE {_HI} END, 6) + 0.0 AS hi FROM dynamo_tbl WHERE tdrot IS NOT NULL")
def multigrid_window(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = g.window_around(c("tdrot"), 15.0)
    return table(spark, d, "dynamo_tbl").where("tdrot is not null").select("row_id", rounded(lo).alias("lo"), rounded(hi).alias("hi"))


@query("SELECT row_id, CASE WHEN fs1 > 0 AND fs2 <= 0 THEN 'particle' WHEN fs2 > 0 AND fs1 <= 0 THEN 'template' ELSE 'both' END AS side FROM dynamo_tbl")
def wedge_side(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dynamo_tbl").select("row_id", g.wedge_side(c("fs1"), c("fs2")).alias("side"))


@query("""
WITH p AS (SELECT DISTINCT ftype, ymintilt, ymaxtilt, xmintilt, xmaxtilt FROM dynamo_tbl WHERE ftype IS NOT NULL AND ymintilt IS NOT NULL),
r AS (SELECT unnest(range(-4, 4)) AS v), k AS (SELECT a.v / 8.0 AS z, b.v / 8.0 AS y, c.v / 8.0 AS x FROM r a, r b, r c),
a AS (SELECT p.*, degrees(atan2(abs(y) + 1e-12, abs(z) + 1e-12)) AS ay, degrees(atan2(abs(x) + 1e-12, abs(z) + 1e-12)) AS ax, degrees(atan2(sqrt(x * x + y * y + 1e-12), abs(z) + 1e-12)) AS co FROM p, k)
SELECT ftype, ymintilt, ymaxtilt, xmintilt, xmaxtilt, count(CASE WHEN CASE WHEN ftype = 1 THEN ay BETWEEN ymintilt AND ymaxtilt WHEN ftype = 2 THEN ax BETWEEN xmintilt AND xmaxtilt
  WHEN ftype = 3 THEN co BETWEEN ymintilt AND ymaxtilt WHEN ftype = 4 THEN ay BETWEEN ymintilt AND ymaxtilt AND ax BETWEEN xmintilt AND xmaxtilt ELSE true END THEN 1 END) AS kept
FROM a GROUP BY ALL""")
def wedge_mask(spark: SparkSession, d: str) -> DataFrame:
    """For each distinct wedge of the table the number of frequencies of an 8 x 8 x 8 box that it keeps."""
    names = ["ftype", "ymintilt", "ymaxtilt", "xmintilt", "xmaxtilt"]
    wedges = table(spark, d, "dynamo_tbl").select(*names).where("ftype is not null and ymintilt is not null").distinct()
    for a in ("kz", "ky", "kx"):
        wedges = wedges.withColumn(a, F.explode(F.sequence(F.lit(-4), F.lit(3)))).withColumn(a, c(a) / 8.0)
    kept = g.in_wedge(c("ftype"), c("kx"), c("ky"), c("kz"), *(c(n) for n in names[1:]))
    return wedges.groupBy(*names).agg(F.count(F.when(kept, 1)).alias("kept"))


@query("""
WITH p AS (SELECT DISTINCT CAST(ref AS BIGINT) AS ref, CAST(ref AS BIGINT) % 3 + 1 AS r FROM dynamo_tbl WHERE ref IS NOT NULL),
m AS (SELECT unnest(['cube', 'ellipsoid_follow', 'ellipsoid_center', 'cylinder_z_follow', 'center_only']) AS mode),
v AS (SELECT unnest(range(-3, 4)) AS v)
SELECT ref, mode, x.v AS dx, y.v AS dy, z.v AS dz FROM p, m, v x, v y, v z
WHERE abs(x.v) <= r AND abs(y.v) <= r AND abs(z.v) <= r AND CASE mode WHEN 'ellipsoid_follow' THEN x.v * x.v + y.v * y.v + z.v * z.v <= r * r
  WHEN 'ellipsoid_center' THEN (x.v + 1) * (x.v + 1) + y.v * y.v + (z.v - 1) * (z.v - 1) <= r * r WHEN 'cylinder_z_follow' THEN x.v * x.v + y.v * y.v <= r * r WHEN 'center_only' THEN x.v = 0 AND y.v = 0 AND z.v = 0 ELSE true END""")
def shift_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The shifts that are searched for each reference, by shape of the range; the centre is (1, 0, -1)."""
    rows = table(spark, d, "dynamo_tbl").select(whole("ref").alias("ref")).where("ref is not null").distinct().withColumn("r", F.pmod("ref", F.lit(3)) + 1)
    rows = rows.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in ("cube", "ellipsoid_follow", "ellipsoid_center", "cylinder_z_follow", "center_only")))))
    for a in ("dx", "dy", "dz"):
        rows = rows.withColumn(a, F.explode(F.sequence(-c("r"), c("r"))))
    return rows.where(g.in_shift_range(c("mode"), (c("dx"), c("dy"), c("dz")), c("r"), (F.lit(1), F.lit(0), F.lit(-1)))).drop("r")


@query("""
WITH p AS (SELECT row_id, tilt FROM dynamo_tbl WHERE tilt IS NOT NULL)
SELECT row_id, len(range(0, CAST(ceil(abs(tilt) / 15 - 1e-9) AS BIGINT))) + (CASE WHEN tilt = 0 THEN 1 ELSE 0 END) AS n_angles, round(CAST(greatest(ceil(abs(tilt) / 15 - 1e-9) - 1, 0) AS DOUBLE) * 15 + least(tilt, 0.0), 6) + 0.0 AS last_angle FROM p""")
def angle_scan(spark: SparkSession, d: str) -> DataFrame:
    """The angles from 0 to each row's tilt in steps of 15 degrees, with reversed bounds swapped."""
    rows = table(spark, d, "dynamo_tbl").where("tilt is not null").select("row_id", g.scan(F.lit(0.0), c("tilt"), F.lit(15.0)).alias("angles"))
    return rows.select("row_id", F.size("angles").cast("bigint").alias("n_angles"), rounded(F.element_at("angles", -1)).alias("last_angle"))


@query("""
WITH p AS (SELECT DISTINCT CAST(ref AS BIGINT) AS ref, 10.0 + CAST(ref AS BIGINT) % 3 * 5 AS spacing FROM dynamo_tbl WHERE ref IS NOT NULL),
t AS (SELECT ref, spacing, unnest(range(0, CAST(floor(90 / spacing + 0.5 + 1e-9) AS BIGINT) + 1)) * spacing AS tilt FROM p),
s AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (cos(radians(spacing)) - cos(radians(tilt)) * cos(radians(tilt))) / greatest(sin(radians(tilt)) * sin(radians(tilt)), 1e-8))))) AS step FROM t)
SELECT ref, tilt, CAST(CASE WHEN tilt IN (0, 180) OR NOT step > 0 THEN 1 ELSE floor(360 / step) + 2 END AS BIGINT) AS n_axes FROM s""")
def angle_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings of axes on the half sphere and how many axes each has, with a spacing for each reference."""
    rows = table(spark, d, "dynamo_tbl").select(whole("ref").alias("ref")).where("ref is not null").distinct()
    rows = rows.withColumn("spacing", F.lit(10.0) + F.pmod("ref", F.lit(3)) * 5)
    rings = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(90.0 / c("spacing") + 0.5 + 1e-9)))).withColumn("tilt", c("i") * c("spacing"))
    return rings.select("ref", "tilt", g.ring_size(c("tilt"), c("spacing")).alias("n_axes"))


@query("""
WITH p AS (SELECT DISTINCT CAST(ref AS BIGINT) AS ref, 10.0 + CAST(ref AS BIGINT) % 3 * 5 AS spacing, CAST(ref AS BIGINT) % 3 + 1 AS r FROM dynamo_tbl WHERE ref IS NOT NULL),
t AS (SELECT *, unnest(range(0, CAST(floor(90 / spacing + 0.5 + 1e-9) AS BIGINT) + 1)) * spacing AS tilt FROM p),
s AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (cos(radians(spacing)) - cos(radians(tilt)) * cos(radians(tilt))) / greatest(sin(radians(tilt)) * sin(radians(tilt)), 1e-8))))) AS step FROM t)
SELECT ref, CAST(sum(CASE WHEN tilt IN (0, 180) OR NOT step > 0 THEN 1 ELSE floor(360 / step) + 2 END) AS BIGINT) AS n_axes, CAST(2 * floor(90 / spacing + 0.5 + 1e-9) + 1 AS BIGINT) AS n_turns, CAST((2 * r + 1) * (2 * r + 1) * (2 * r + 1) AS BIGINT) AS n_shifts,
  n_axes * n_turns * n_shifts AS n_candidates FROM s GROUP BY ref, spacing, r""")
def candidate_grid(spark: SparkSession, d: str) -> DataFrame:
    """How many poses the search of each reference tries: axes of a half sphere, turns within 180 degrees, shifts of a cube.
    The candidates themselves are made inside the tasks that score them."""
    rings = angle_rings(spark, d).groupBy("ref").agg(F.sum("n_axes").alias("n_axes"))
    spacing, r = F.lit(10.0) + F.pmod("ref", F.lit(3)) * 5, F.pmod("ref", F.lit(3)) + 1
    turns = 2 * F.floor(90.0 / spacing + 0.5 + 1e-9) + 1
    shifts = (2 * r + 1) * (2 * r + 1) * (2 * r + 1)
    return rings.select("ref", "n_axes", turns.alias("n_turns"), shifts.cast("bigint").alias("n_shifts"), (c("n_axes") * turns * shifts).cast("bigint").alias("n_candidates"))


@query("""
WITH p AS (SELECT DISTINCT CAST(ref AS BIGINT) AS ref, 10.0 + CAST(ref AS BIGINT) % 3 * 5 AS spacing FROM dynamo_tbl WHERE ref IS NOT NULL),
t AS (SELECT ref, spacing, unnest(range(0, CAST(floor(90 / spacing + 0.5 + 1e-9) AS BIGINT) + 1)) * spacing AS tilt FROM p),
s AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (cos(radians(spacing)) - cos(radians(tilt)) * cos(radians(tilt))) / greatest(sin(radians(tilt)) * sin(radians(tilt)), 1e-8))))) AS step FROM t),
n AS (SELECT ref, spacing, tilt, CAST(CASE WHEN tilt IN (0, 180) OR NOT step > 0 THEN 1 ELSE floor(360 / step) + 2 END AS BIGINT) AS n FROM s),
a AS (SELECT ref, spacing, tilt, n, unnest(range(0, n)) AS k FROM n)
SELECT ref, tilt, k AS axis, round(k * 360.0 / n, 6) + 0.0 AS azimuth, turn, round(turn * spacing, 6) + 0.0 AS inplane
FROM a, LATERAL (SELECT unnest(range(-CAST(floor(90 / spacing + 0.5 + 1e-9) AS BIGINT), CAST(floor(90 / spacing + 0.5 + 1e-9) AS BIGINT) + 1)) AS turn)""")
def candidate_angles(spark: SparkSession, d: str) -> DataFrame:
    """The orientations that the search of each reference tries: every axis of its rings with every turn about it. Each comes with
    the shifts of shift_candidates."""
    spacing = F.lit(10.0) + F.pmod("ref", F.lit(3)) * 5
    last = F.floor(90.0 / spacing + 0.5 + 1e-9)
    axes = angle_rings(spark, d).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), c("n_axes") - 1)).alias("axis"))
    turns = axes.withColumn("turn", F.explode(F.sequence(-last, last)))
    return turns.select("ref", "tilt", "axis", rounded(c("axis") * 360.0 / c("n_axes")).alias("azimuth"), "turn", rounded(c("turn") * spacing).alias("inplane"))


@query("""
WITH w AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id, round(CASE WHEN abs(l - 2 * value + r) < 1e-8 THEN 0 ELSE greatest(-1.0, least(1.0, (l - r) / 2 / (l - 2 * value + r))) END, 6) + 0.0 AS top FROM w WHERE value > l AND value > r""")
def parabolic_peak(spark: SparkSession, d: str) -> DataFrame:
    """Where the values of a user have a local peak, and how far beside it the parabola's top lies."""
    rows = in_order(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], ["value"])
    top = g.parabola_offset(c("previous_value"), c("value"), c("next_value"))
    return rows.where("value > previous_value and value > next_value").select("user_id", "event_id", rounded(top).alias("top"))


@query("""
WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events)
SELECT event_id, user_id, event_type FROM w WHERE l IS NULL OR l <> event_type""")
def consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Without events that repeat the one before."""
    rows = in_order(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return rows.where("previous_event_type is null or previous_event_type <> event_type").select("event_id", "user_id", "event_type")


@query("SELECT star_id, CASE WHEN averaged = 1 THEN printf('particle_%012d.mrc', tag) ELSE printf('noise_%012d.mrc', tag) END AS file FROM star_particles")
def zero_pad_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "star_particles").select("star_id", F.when(c("averaged") == 1, F.format_string("particle_%012d.mrc", "tag")).otherwise(F.format_string("noise_%012d.mrc", "tag")).alias("file"))


@query("SELECT row_id, printf('%.6g', dx) AS dx, printf('%.6g', cc2) AS cc2, printf('%.6g', x) AS x, printf('%.6g', xmaxtilt * 1e7 + 0.125) AS large, printf('%.6g', tilt / 1e7) AS small FROM dynamo_tbl WHERE dx IS NOT NULL AND cc2 IS NOT NULL AND x IS NOT NULL AND tilt IS NOT NULL AND xmaxtilt IS NOT NULL")
def tbl_format(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as the table's writer prints them: six significant digits, no trailing zeros."""
    rows = table(spark, d, "dynamo_tbl").dropna(subset=["dx", "cc2", "x", "tilt", "xmaxtilt"])
    values = {"dx": c("dx"), "cc2": c("cc2"), "x": c("x"), "large": c("xmaxtilt") * 1e7 + 0.125, "small": c("tilt") / 1e7}
    return rows.select("row_id", *(general_format(v).alias(n) for n, v in values.items()))


@query("SELECT row_id, CASE WHEN coalesce(ref, 0) = 0 THEN 1.0 ELSE ref END AS ref, CASE WHEN coalesce(tilt, 0) = 0 THEN -1.0 ELSE tilt END AS tilt, coalesce(TRY_CAST(CAST(npar AS VARCHAR) AS DOUBLE), 7.0) AS npar FROM dynamo_tbl")
def falsy_default(spark: SparkSession, d: str) -> DataFrame:
    """A default for null and 0; a default for what is no number."""
    falsy = lambda n, default: F.when(F.coalesce(c(n), F.lit(0.0)) == 0, default).otherwise(c(n)).alias(n)
    return table(spark, d, "dynamo_tbl").select("row_id", falsy("ref", 1.0), falsy("tilt", -1.0), F.coalesce(c("npar").cast("string").try_cast("double"), F.lit(7.0)).alias("npar"))


@query(r"SELECT entry_id, CASE WHEN f LIKE '.%' AND f NOT LIKE '.%.%' THEN f ELSE regexp_replace(f, '\.[^.]*$', '') END AS name FROM (SELECT entry_id, regexp_replace(trim(tomo_path, e' \t\r\n'), '^.*/', '') AS f FROM vll WHERE trim(tomo_path, e' \t\r\n') <> '' AND trim(tomo_path, e' \t\r\n') NOT LIKE '#%')")
def vll_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the tomograms of a list: base names without the last ending; a leading dot is no ending."""
    rows = table(spark, d, "vll").select("entry_id", trimmed("tomo_path").alias("path")).where("path is not null and not startswith(path, '#')")
    return rows.select("entry_id", F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(?<=.)\.[^.]*\z", "").alias("name"))


_TOKEN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_IMAGINARY = r"[+-]([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[iIjJ]"


@query(rf"""
WITH t AS (SELECT line_id, regexp_split_to_array(trim(line, e' \t\r\n'), '[ \t\r]+') AS f FROM tbl_lines WHERE trim(line, e' \t\r\n') <> ''),
v AS (SELECT line_id, len(f) AS n_tokens, list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '{_TOKEN[1:]}({_IMAGINARY})?') THEN TRY_CAST(regexp_extract(x, '{_TOKEN}') AS DOUBLE) END) AS v FROM t)
SELECT line_id, n_tokens, """ + ", ".join(f"CASE WHEN isinf(v[{i + 1}]) THEN NULL ELSE v[{i + 1}] END AS {n}" for i, n in enumerate(TBL_COLUMNS)) + " FROM v")
def scan_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the lenient reader takes them: split at blanks, complex tokens by their real part, other tokens and missing ones null."""
    return token_columns(_bare_lines(spark, d)).drop("line")


def _bare_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tbl_lines").select("line_id", trimmed("line").alias("line")).where("line is not null")


@query(rf"""
WITH t AS (SELECT line_id, regexp_split_to_array(trim(line, e' \t\r\n'), '[ \t\r]+') AS f FROM tbl_lines WHERE trim(line, e' \t\r\n') <> ''),
v AS (SELECT line_id, unnest(f) AS x, generate_subscripts(f, 1) AS position FROM t WHERE len(f) > 35)
SELECT line_id, position, CASE WHEN regexp_full_match(x, '{_TOKEN[1:]}({_IMAGINARY})?') AND NOT isinf(TRY_CAST(regexp_extract(x, '{_TOKEN}') AS DOUBLE)) THEN TRY_CAST(regexp_extract(x, '{_TOKEN}') AS DOUBLE) END AS value FROM v WHERE position > 35""")
def scan_extra(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of wide lines beyond the 35 columns, which the reader names col36 and so on."""
    lines = _bare_lines(spark, d)
    width = lines.agg(F.max(F.size(F.split("line", r"[ \t\r]+")))).first()[0] or 0
    names = [f"col{i}" for i in range(len(TBL_COLUMNS) + 1, width + 1)]
    wide = token_columns(lines, width=max(width, len(TBL_COLUMNS))).where(c("n_tokens") > len(TBL_COLUMNS))
    pairs = F.array(*(F.struct(F.lit(int(n[3:])).cast("bigint").alias("position"), c(n).alias("value")) for n in names)) if names else F.array().cast("array<struct<position:bigint,value:double>>")
    return wide.select("line_id", "n_tokens", F.inline(pairs)).where("position <= n_tokens").drop("n_tokens")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_type":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_type IS NOT NULL""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p")).where("p.k is not null and event_type is not null")
    return rows.select("event_id", "p.k", F.to_json(F.struct("event_type", "p.k")).alias("again"))


@query("""
WITH h AS (SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS base, count(*) FILTER (WHERE event_id % 2 = 1) AS now FROM events GROUP BY 1)
SELECT event_type, base, now, round((base - now) / CAST(base AS DOUBLE), 6) + 0.0 AS slowdown, (base - now) / CAST(base AS DOUBLE) > 0.2 AS regressed FROM h WHERE base > 0 AND now > 0""")
def regression_join(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the events as baseline and current counts, joined by type, against the limit of 20 percent."""
    rows = table(spark, d, "events")
    count = lambda part, name: rows.where(F.pmod("event_id", F.lit(2)) == part).groupBy("event_type").agg(F.count("*").alias(name))
    loss = (c("base") - c("now")) / c("base")
    return count(0, "base").join(count(1, "now"), "event_type").select("event_type", "base", "now", rounded(loss).alias("slowdown"), (loss > 0.2).alias("regressed"))


@query("""
WITH w AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS passed FROM events),
e AS (SELECT *, CAST(floor(passed * (total - done) / CAST(done AS DOUBLE)) AS BIGINT) AS eta FROM w)
SELECT user_id, event_id, done, total, printf('%02d:%02d:%02d', eta // 3600, eta // 60 % 60, eta % 60) AS eta FROM e""")
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """How far each user's events are, and the time left at the pace so far."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    rows = in_order(rows, ["user_id"], ["ts", "event_id"], firsts=["us"]).withColumnsRenamed({"place": "done", "group_size": "total"})
    rows = rows.withColumn("passed", F.expr("(us - first_us) div 1000000"))
    left = F.floor(c("passed") * (c("total") - c("done")) / c("done")).cast("bigint")
    return rows.select("user_id", "event_id", "done", "total", hms(left).alias("eta"))


@query("""
WITH s AS (SELECT entry_id, (entry_id * 48271 + 12820163) % 2147483647 AS s1 FROM vll), t AS (SELECT entry_id, s1, s1 * 48271 % 2147483647 AS s2 FROM s), u AS (SELECT *, s2 * 48271 % 2147483647 AS s3 FROM t)
SELECT entry_id, round(16 + s1 / 2147483647.0 * 928, 6) AS x, round(16 + s2 / 2147483647.0 * 896, 6) AS y, round(16 + s3 / 2147483647.0 * 368, 6) AS z FROM u""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """One position in each tomogram of the list, half a box from its sides, drawn from the row's id alone."""
    step = lambda s: F.pmod(s * 48271, F.lit(2147483647))
    rows = table(spark, d, "vll").select("entry_id", F.pmod(c("entry_id") * 48271 + 12820163, F.lit(2147483647)).alias("s1")).withColumn("s2", step(c("s1"))).withColumn("s3", step(c("s2")))
    return rows.select("entry_id", *(F.round(SIDE / 2 + c(s) / 2147483647.0 * (size - SIDE), 6).alias(a) for a, s, size in zip("xyz", ("s1", "s2", "s3"), TOMO_SIZE)))
