"""The operators of volumes and of vectors of fixed length: means, scores, assignment, alignment, classification.

`embeddings` hold boxes of 4 x 4 x 4 values and a class each, `tomo_volumes` small stored volumes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions import volume as v
from tomoframe.functions.columns import let
from tomoframe.operators import volumes as ops
from tomoframe.plans.registry import Registry, rounded
from tomoframe.session import BROADCAST_BYTES, broadcast_if_small, measured, table, written
from tomoframe.sources.tables import optics, star_rows

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
query = R.query
c = F.col

_STAR_COLUMNS = ["tag", "rlnImageName", "rlnMicrographName", "x", "y", "z"]
_LONG = "(SELECT vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings)"


def _doubles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", c("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _means(rows: DataFrame, key: str, old: DataFrame | None = None) -> DataFrame:
    """The mean vector of each key, as `m`: averaged by position, with one partial sum per task, key and position. Keys of
    `old` (key, m) without rows keep their old mean, other keys of `rows` than these don't occur."""
    by = rows.select(key, F.posexplode("e").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x")).select(key, F.struct("pos", "x").alias("v"), F.lit(None).cast("array<double>").alias("m"))
    if old is not None:
        by = by.unionByName(old.select(key, F.lit(None).cast("struct<pos:int,x:double>").alias("v"), "m"))
    of_key = by.groupBy(key).agg(F.array_sort(F.collect_list("v")).alias("v"), F.first("m", ignorenulls=True).alias("m"))
    return of_key.select(key, F.when(F.size("v") > 0, F.transform("v", lambda p: p["x"])).otherwise(c("m")).alias("m"))


def _unit(x: Column) -> Column:
    """An array without its mean, and its length as a vector. Every intermediate array is computed once."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    length = lambda p: F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, y: s + y * y))
    centred = let(total(x) / F.size(x), lambda mu: F.transform(x, lambda y: y - mu))
    return let(centred, lambda p: F.struct(p.alias("p"), length(p).alias("size")))


def _ncc(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays given as their units; 0 if one is flat."""
    dot = F.aggregate(F.zip_with(a["p"], b["p"], lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    return let(a["size"] * b["size"], lambda size: F.when(size < 1e-12, 0.0).otherwise(dot / size))


def _with_units(rows: DataFrame) -> DataFrame:
    """`rows` with the unit of e as `u`. A generator makes it, so that it isn't computed again for every reference."""
    return rows.withColumn("u", F.explode(F.array(_unit(c("e")))))


def _n_blocks(means: DataFrame) -> int:
    """In how many parts the references (ref, m) go to the rows, so that each has at most about BROADCAST_BYTES: one, unless
    they have been measured to be larger."""
    return max(1, -(-2 * measured(means) // BROADCAST_BYTES))


def _blocks(means: DataFrame, n: int) -> list[Column]:
    """The references as `n` arrays of (ref, u), u being the unit of m; each array is a scalar."""
    units = means.select("ref", _unit(c("m")).alias("u"), F.pmod(F.xxhash64("ref"), F.lit(n)).alias("block"))
    return [units.where(c("block") == k).agg(F.array_sort(F.collect_list(F.struct("ref", "u")))).scalar() for k in range(n)]


def _with_best(rows: DataFrame, means: DataFrame, n: int) -> DataFrame:
    """`rows` (e) with `best`: struct(cc, r) of the reference that is most like e, r being minus its number, so that the lowest
    of equal ones wins; NaN never does. The references go to the rows, which aren't shuffled."""
    blocks = _blocks(means, n)
    for k, refs in enumerate(blocks):
        cc = lambda r: let(F.round(_ncc(c("u"), r["u"]), 9), lambda x: F.when(~F.isnan(x), x))
        found = F.array_max(F.transform("refs", lambda r: F.struct(cc(r).alias("cc"), (-r["ref"]).alias("r"))))
        rows = _with_units(rows).withColumn("refs", refs).withColumn("best", F.greatest("best", found) if k else found).drop("u", "refs")
        if k + 1 < len(blocks):
            rows = written(rows, "best")
    return rows


@query(f"SELECT pos, round(avg(x), 6) + 0.0 AS mean FROM {_LONG} GROUP BY 1")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(spark, d).select(F.posexplode("e").alias("pos", "x")).groupBy(c("pos").cast("bigint").alias("pos")).agg(rounded(F.avg("x")).alias("mean"))


@query(f"SELECT label, pos, round(avg(x), 6) + 0.0 AS mean, count(*) AS n FROM {_LONG} GROUP BY 1, 2")
def class_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = _doubles(spark, d).select("label", F.posexplode("e").alias("pos", "x"))
    return rows.groupBy("label", c("pos").cast("bigint").alias("pos")).agg(rounded(F.avg("x")).alias("mean"), F.count("*").alias("n"))


_MASK = "(SELECT pos FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) WHERE x > 0)"


def _mask(spark: SparkSession, d: str) -> Column:
    """For each position whether the first vector is above 0 there; a constant of one vector's length."""
    first = _doubles(spark, d).agg(F.min_by("e", "vec_id")).first()[0] or []
    return F.array(*(F.lit(x > 0) for x in first)).cast("array<boolean>")


@query(f"SELECT vec_id, round(avg(x), 6) + 0.0 AS mean FROM {_LONG} WHERE pos IN {_MASK} GROUP BY 1")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    under = F.filter(F.zip_with("e", _mask(spark, d), lambda x, m: F.when(m, x)), lambda x: x.isNotNull())
    mean = F.aggregate(under, F.lit(0.0), lambda s, x: s + x) / F.size(under)
    return _doubles(spark, d).select("vec_id", rounded(mean).alias("mean"))


@query(f"SELECT vec_id, round(avg(CASE WHEN pos IN {_MASK} AND x > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM {_LONG} GROUP BY 1")
def mask_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of positions at which a vector and the mask are both above 0."""
    both = F.filter(F.zip_with("e", _mask(spark, d), lambda x, m: m & (x > 0)), lambda b: b)
    return _doubles(spark, d).select("vec_id", F.round(F.size(both) / F.size("e"), 6).alias("coverage"))


@query(f"SELECT vec_id, round(min(x), 6) + 0.0 AS smallest, round(max(x), 6) + 0.0 AS largest, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std FROM (SELECT vec_id, CAST(x AS DOUBLE) AS x FROM {_LONG}) GROUP BY 1")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    mean = F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.size("e")
    rows = _doubles(spark, d).select("vec_id", "e", mean.alias("mu"))
    spread = F.sqrt(F.aggregate(F.transform("e", lambda x: (x - c("mu")) * (x - c("mu"))), F.lit(0.0), lambda s, x: s + x) / F.size("e"))
    return rows.select("vec_id", rounded(F.array_min("e")).alias("smallest"), rounded(F.array_max("e")).alias("largest"), rounded(c("mu")).alias("mean"), F.round(spread, 6).alias("std"))


_SCORES = f"""
l AS (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {_LONG}), m AS (SELECT label AS ref, pos, avg(x) AS m FROM l GROUP BY 1, 2),
s AS (SELECT vec_id, label, ref, coalesce(corr(x, m), 0) AS cc FROM l JOIN m USING (pos) GROUP BY 1, 2, 3)"""


def _classes(rows: DataFrame) -> DataFrame:
    """The mean of each class, as ref and m, written once."""
    return written(_means(rows, "label").withColumnRenamed("label", "ref"), "means")


@query(f"WITH {_SCORES} SELECT vec_id, ref, round(cc, 6) + 0.0 AS cc FROM s")
def ncc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The score of each vector against each class mean. The means come as arrays of a measured size, so that no row moves."""
    rows = _doubles(spark, d)
    means = _classes(rows)
    scores = F.transform("refs", lambda r: F.struct(r["ref"].alias("ref"), _ncc(c("u"), r["u"]).alias("cc")))
    pairs = [_with_units(rows).select("vec_id", "u", refs.alias("refs")).select("vec_id", F.explode(scores).alias("s")) for refs in _blocks(means, _n_blocks(means))]
    return reduce(DataFrame.unionByName, pairs).select("vec_id", "s.ref", rounded(c("s.cc")).alias("cc"))


@query(f"WITH {_SCORES} SELECT vec_id, min(ref) AS ref, round(max(cc), 6) + 0.0 AS cc FROM (SELECT *, max(round(cc, 9)) OVER (PARTITION BY vec_id) AS best FROM s) WHERE round(cc, 9) = best GROUP BY 1")
def mra_assign(spark: SparkSession, d: str) -> DataFrame:
    """The class whose mean a vector is most like; the lowest of equal ones."""
    rows = _doubles(spark, d)
    means = _classes(rows)
    return _with_best(rows, means, _n_blocks(means)).select("vec_id", (-c("best.r")).alias("ref"), rounded(c("best.cc")).alias("cc"))


@query(f"""WITH {_SCORES}, n AS (SELECT min(ref) AS lo, max(ref) AS hi FROM m)
SELECT s.vec_id, ref, round(cc, 6) + 0.0 AS cc FROM s, n WHERE ref = least(greatest(label - 1, lo), hi)""")
def assigned_ref_join(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with one reference of its own, the label less one, cut to the range that there is."""
    rows = _doubles(spark, d)
    refs = _means(rows, "label").withColumnRenamed("label", "ref")
    ends = rows.agg(F.min("label"), F.max("label")).first()
    own = rows.withColumn("ref", F.least(F.greatest(c("label") - 1, F.lit(ends[0])), F.lit(ends[1])))
    return own.join(broadcast_if_small(refs), "ref").select("vec_id", "ref", rounded(_ncc(_unit(c("e")), _unit(c("m")))).alias("cc"))


def _iteration(i: int) -> str:
    return f"""
s{i} AS (SELECT vec_id, ref, coalesce(corr(x, m), 0) AS cc FROM l JOIN m{i} USING (pos) GROUP BY 1, 2),
a{i} AS (SELECT vec_id, min(ref) AS ref FROM (SELECT *, max(round(cc, 9)) OVER (PARTITION BY vec_id) AS best FROM s{i}) WHERE round(cc, 9) = best GROUP BY 1),
m{i + 1} AS (SELECT ref, pos, coalesce(n.m, m{i}.m) AS m FROM m{i} LEFT JOIN (SELECT ref, pos, avg(x) AS m FROM l JOIN a{i} USING (vec_id) GROUP BY 1, 2) n USING (ref, pos))"""


def _iterated(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The means after three rounds begun with the classes of `first`."""
    means = _classes(first)
    n = _n_blocks(means)  # stays the same: a class without vectors keeps its mean
    for _ in range(3):
        own = _with_best(rows, means, n).select((-c("best.r")).alias("ref"), "e")
        means = written(_means(own, "ref", means), "means")
    return means.select("ref", F.posexplode("m").alias("pos", "x")).select("ref", c("pos").cast("bigint").alias("pos"), rounded(c("x"), 5).alias("mean"))


@query(f"""
WITH l AS MATERIALIZED (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {_LONG}), m0 AS (SELECT label AS ref, pos, avg(x) AS m FROM l WHERE vec_id % 2 = 0 GROUP BY 1, 2), {_iteration(0)}, {_iteration(1)}, {_iteration(2)}
SELECT ref, pos, round(m, 5) + 0.0 AS mean FROM m3""")
def mra_iterate(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of assignment to the best mean and new means, begun with the classes of every second vector. A class
    without vectors keeps its mean. Each round's means are written, which ends the lineage."""
    rows = _doubles(spark, d)
    return _iterated(rows, rows.where(F.pmod("vec_id", F.lit(2)) == 0))


@query(f"""
WITH l AS MATERIALIZED (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {_LONG}), m0 AS (SELECT label AS ref, pos, avg(x) AS m FROM l GROUP BY 1, 2), {_iteration(0)}, {_iteration(1)}, {_iteration(2)}
SELECT ref, pos, round(m, 5) + 0.0 AS mean FROM m3""")
def mra_iterate_all(spark: SparkSession, d: str) -> DataFrame:
    """As mra_iterate, begun with the classes of all vectors, so that every class has a reference."""
    rows = _doubles(spark, d)
    return _iterated(rows, rows)


@query()
def local_ncc(spark: SparkSession, d: str) -> DataFrame:
    """The local score of each box against the mean of its class."""
    rows = _doubles(spark, d)
    pairs = rows.join(broadcast_if_small(_means(rows, "label")), "label").select("vec_id", "label", "e", "m")

    def run(batches):
        for pdf in batches:
            score = [v.local_ncc(np.array(e).reshape(4, 4, 4), np.array(m).reshape(4, 4, 4), width=3) for e, m in zip(pdf["e"], pdf["m"])]
            yield pdf[["vec_id", "label"]].assign(cc=score)

    return pairs.mapInPandas(run, "vec_id bigint, label bigint, cc double")


@query()
def volume_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Stored volumes decoded, with their statistics."""
    return ops.statistics(table(spark, d, "tomo_volumes"), ["path", "created_at"])


@query()
def volume_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean volume of each shape, one row per voxel."""
    means = ops.volume_means(table(spark, d, "tomo_volumes"), [])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                x = np.frombuffer(r.data, "<f4").astype(float)
                yield pd.DataFrame({"nz": r.nz, "ny": r.ny, "nx": r.nx, "voxel": np.arange(x.size), "n": r.n, "mean": np.round(x, 5)})

    return means.mapInPandas(run, "nz int, ny int, nx int, voxel bigint, n bigint, mean double")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tomo_volumes").select("path", "created_at", "nz", "ny", "nx", "data")


def _references(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean volume of each shape, numbered from the most frequent shape on."""
    return {k: ops.box(m) for k, m in enumerate(ops.volume_means(rows, []).orderBy(F.desc("n"), "nz", "ny", "nx").collect(), 1)}


#: All orientations and the operator's own shifts.
_SEARCH = v.Search()


@query()
def align_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Every stored volume aligned to the mean volume of its shape; what can't be aligned has the reason."""
    rows = _keyed(spark, d)
    return ops.aligned(rows, _references(rows), _SEARCH, ["path", "created_at"]).drop("data", "nz", "ny", "nx")


@query()
def classify_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of alignment against two references for each shape, which are the means of the volumes above and below
    the mean level."""
    from tomoframe.plans.pipelines import classify, split_references

    rows = _keyed(spark, d)
    last = classify(rows, split_references(rows), _SEARCH, ["path", "created_at"], iterations=3)
    return last.rows.drop("data", "nz", "ny", "nx")


@query(r"""
WITH parts AS (SELECT file_id, regexp_split_to_array(content, '\r\n|\n|\r') AS l FROM particle_files WHERE content IS NOT NULL),
lines AS (SELECT file_id, trim(unnest(l), e' \t') AS s, generate_subscripts(l, 1) AS i FROM parts),
marked AS (SELECT *, sum(CASE WHEN starts_with(lower(s), 'data_') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b FROM lines WHERE s <> '' AND NOT starts_with(s, '#')),
chosen AS (SELECT file_id, coalesce(min(CASE WHEN lower(s) = 'data_particles' THEN b END), min(CASE WHEN lower(s) <> 'data_optics' THEN b END)) AS b FROM marked WHERE starts_with(lower(s), 'data_') GROUP BY 1),
own AS (SELECT m.* FROM marked m JOIN chosen USING (file_id, b)),
labels AS (SELECT file_id, regexp_extract(s, '^_(\S+)', 1) AS label, row_number() OVER (PARTITION BY file_id ORDER BY i) AS c FROM own WHERE starts_with(s, '_')),
heads AS (SELECT file_id, count(*) AS n, map_from_entries(list((label, c))) AS where_ FROM labels GROUP BY 1),
found AS (SELECT file_id, list_transform(regexp_extract_all(s, '"[^"]*"|''[^'']*''|\S+'), lambda x: regexp_replace(x, '^["''](.*)["'']$', '\1')) AS v FROM own WHERE NOT starts_with(s, '_') AND NOT starts_with(lower(s), 'data_') AND lower(s) <> 'loop_')
SELECT file_id, """ + ", ".join(f"v[where_['{n}']] AS \"{n}\"" for n in _STAR_COLUMNS) + " FROM found JOIN heads USING (file_id) WHERE len(v) = n")
def star_scan(spark: SparkSession, d: str) -> DataFrame:
    """The particle rows of every STAR text as it stands."""
    files = table(spark, d, "particle_files").select("file_id", "content")
    return star_rows(files, _STAR_COLUMNS)


@query(r"""
WITH b AS (SELECT file_id, regexp_extract(content, '(?:^|[\r\n])data_optics\s+loop_\s+_rlnOpticsGroup[^\r\n]*\s+_rlnImageSizeX[^\r\n]*\s+\S+\s+([0-9]+)', 1) AS s FROM particle_files)
SELECT file_id, CASE WHEN s <> '' THEN CAST(s AS BIGINT) END AS image_size FROM b""")
def star_optics(spark: SparkSession, d: str) -> DataFrame:
    """The image size in the first row of each file's optics block."""
    return optics(table(spark, d, "particle_files"))
