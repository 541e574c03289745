"""Queries of the general data problems: orphan references, heavy keys, rows that fail to parse, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.columns import micros, trimmed, whole
from tomoframe.operators import bad_rows, compaction, heavy_keys
from tomoframe.operators.references import orphan_references
from tomoframe.schema import TBL_COLUMNS
from tomoframe.session import table

VALUES, ANGLES = ["cc", "dx", "dy", "dz", "tilt"], ["tdrot", "narot"]


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """tomo, rlnMicrographName and tomo_path as keys with their time. A name of digits only refers to a name or to an id."""
    tbl = table(spark, folder, "dynamo_tbl").select(F.lit("dynamo_tbl").alias("src_table"), F.col("row_id").alias("row_key"), F.concat(F.lit("i:"), whole("tomo").cast("string")).alias("key"), micros("loaded_at").alias("t"), F.lit(1).alias("n_keys"))
    name = F.regexp_replace(F.regexp_replace(trimmed("rlnMicrographName"), "^.*/", ""), r"\.mrc$", "")
    digits = F.col("name").rlike("^[0-9]+$")
    star = (
        table(spark, folder, "star_particles")
        .select("star_id", name.alias("name"), micros("loaded_at").alias("t"))
        .where("trim(name) != ''")
        .select(
            F.lit("star_particles").alias("src_table"),
            F.col("star_id").alias("row_key"),
            F.explode(F.when(digits, F.array(F.concat(F.lit("n:"), "name"), F.concat(F.lit("i:"), F.regexp_replace("name", "^0+(?=[0-9])", "")))).otherwise(F.array(F.concat(F.lit("n:"), "name")))).alias("key"),
            "t",
            F.when(digits, 2).otherwise(1).alias("n_keys"),
        )
    )
    vll = table(spark, folder, "vll").select(F.lit("vll").alias("src_table"), F.col("entry_id").alias("row_key"), F.concat(F.lit("p:"), trimmed("tomo_path")).alias("key"), micros("registered_at").alias("t"), F.lit(1).alias("n_keys"))
    return tbl.unionByName(star).unionByName(vll)


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    vll = table(spark, folder, "vll").select("tomo_id", "rlnMicrographName", micros("registered_at").alias("begins"), micros("deleted_at").alias("ends"))
    volumes = table(spark, folder, "tomo_volumes")
    by_id = vll.select(F.concat(F.lit("i:"), F.col("tomo_id").cast("string")).alias("key"), "begins", "ends")
    by_name = vll.select(F.concat(F.lit("n:"), "rlnMicrographName").alias("key"), "begins", "ends")
    by_path = volumes.select(F.concat(F.lit("p:"), "path").alias("key"), micros("created_at").alias("begins"), micros("removed_at").alias("ends"))
    return by_id.unionByName(by_name).unionByName(by_path)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(_references(spark, folder), _parents(spark, folder)).select("src_table", "row_key")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table and month of their time, by reason."""
    orphans = orphan_references(_references(spark, folder), _parents(spark, folder))
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    of = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}")
    return orphans.groupBy("src_table", month.alias("period")).agg(F.count(F.lit(1)).alias("n_orphans"), of("missing"), of("late"), of("deleted"))


def _joined_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dynamo_tbl").select(whole("tomo").alias("tomo"), whole("ref").alias("ref"), *VALUES, *ANGLES)
    entries = table(spark, folder, "vll").select(F.col("tomo_id").alias("tomo"))
    return heavy_keys.join_states(heavy_keys.states(rows, ["tomo", "ref"], VALUES, ANGLES), heavy_keys.states(entries, ["tomo"], []), "tomo")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with at least 3 percent of all rows, by the counts of the joined states."""
    return heavy_keys.heavy(_joined_states(spark, folder), ["tomo", "ref"], 3).select("field", "key_value")


def p3_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Row count, listed rows, (row, list entry) pairs, mean cc and mean pose per tomo and per ref."""
    per_key = heavy_keys.rolled_up(_joined_states(spark, folder), ["tomo", "ref"], VALUES, ANGLES)
    counts = ["n_rows", "n_matched", "n_pairs"]
    rest = [c for c in per_key.columns if c.startswith(("mean_", "spread_"))]
    return per_key.select("field", "key_value", *(F.col(c).cast("bigint").alias(c) for c in counts), *(F.round(c, 12).cast("float").cast("double").alias(c) for c in rest))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return bad_rows.classified(table(spark, folder, "tbl_lines")).where("reason is not null").select("line_id")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return bad_rows.classified(table(spark, folder, "tbl_lines")).where("reason is not null").select("line_id", "reason")


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows as numbers."""
    return bad_rows.classified(table(spark, folder, "tbl_lines")).where("reason is null").select("line_id", *(F.col(f"row.`{c}`").alias(c) for c in TBL_COLUMNS))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.consolidated(table(spark, folder, "particle_files")).rows


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the files and their rows, one row per count."""
    files = table(spark, folder, "particle_files")
    counts = compaction.consolidated(files).counts if not files.isEmpty() else {}
    return spark.createDataFrame(list(counts.items()), "item string, n bigint")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_per_key, p4_found, p4_reasons, p4_rows, p5_found, p5_report)}

_ORPHANS = r"""
WITH refs AS (
  SELECT 'dynamo_tbl' AS src_table, row_id AS row_key, CAST(CAST(round(tomo) AS BIGINT) AS VARCHAR) AS id_key, NULL AS name_key, NULL AS path_key, loaded_at AS t
  FROM dynamo_tbl WHERE tomo IS NOT NULL AND NOT isnan(tomo)
  UNION ALL
  SELECT 'star_particles', star_id, CASE WHEN regexp_full_match(name, '[0-9]+') THEN regexp_replace(name, '^0+([0-9])', '\1') END, name, NULL, loaded_at
  FROM (SELECT star_id, loaded_at, regexp_replace(regexp_replace(trim("rlnMicrographName", e' \t\r\n'), '^.*/', ''), '\.mrc$', '') AS name FROM star_particles)
  WHERE trim(name) <> ''
  UNION ALL
  SELECT 'vll', entry_id, NULL, NULL, trim(tomo_path, e' \t\r\n'), registered_at FROM vll WHERE trim(tomo_path, e' \t\r\n') <> ''
), parents AS (
  SELECT 'i' AS kind, CAST(tomo_id AS VARCHAR) AS key, registered_at AS b, deleted_at AS e FROM vll
  UNION ALL SELECT 'n', "rlnMicrographName", registered_at, deleted_at FROM vll
  UNION ALL SELECT 'p', path, created_at, removed_at FROM tomo_volumes
), keyed AS (
  SELECT src_table, row_key, t, 'i' AS kind, id_key AS key FROM refs WHERE id_key IS NOT NULL
  UNION ALL SELECT src_table, row_key, t, 'n', name_key FROM refs WHERE name_key IS NOT NULL
  UNION ALL SELECT src_table, row_key, t, 'p', path_key FROM refs WHERE path_key IS NOT NULL
), judged AS (
  SELECT src_table, row_key, t, count(p.key) AS known, count(CASE WHEN p.b <= t THEN 1 END) AS begun,
         count(CASE WHEN p.b <= t AND (p.e IS NULL OR t < p.e) THEN 1 END) AS live
  FROM keyed LEFT JOIN parents p ON keyed.kind = p.kind AND keyed.key = p.key GROUP BY 1, 2, 3
), orphans AS (
  SELECT src_table, row_key, t, CASE WHEN begun > 0 THEN 'deleted' WHEN known > 0 THEN 'late' ELSE 'missing' END AS reason FROM judged WHERE live = 0
)
"""
_FIELD = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?([+-]([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[iIjJ])?"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LINES = rf"""
WITH bare AS (
  SELECT line_id, trim(regexp_replace(line, '\r$', ''), e' \t') AS s FROM tbl_lines
), split AS (
  SELECT line_id, regexp_replace(' ' || replace(s, ' ', '  ') || ' ', '[ \t]"[^"]*"[ \t]', ' ', 'g') LIKE '%"%' AS broken,
         list_transform(regexp_extract_all(s, '("[^"]*"|[^ \t]+)', 1), lambda f: CASE WHEN f LIKE '"%' THEN trim(trim(f, '"'), e' \t') ELSE f END) AS f
  FROM bare WHERE s <> '' AND s NOT LIKE '#%'
), cast_ AS (
  SELECT line_id, broken, len(f) AS n, list_transform(f, lambda x: regexp_full_match(x, '{_FIELD}') AND abs(TRY_CAST(regexp_extract(x, '{_REAL}') AS DOUBLE)) < 'inf'::DOUBLE OR lower(x) = 'nan') AS good,
         list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '{_FIELD}') THEN TRY_CAST(regexp_extract(x, '{_REAL}') AS DOUBLE) END) AS v
  FROM split
), judged AS (
  SELECT line_id, v, CASE WHEN broken THEN 'quoting' WHEN n <> 35 THEN 'columns' WHEN list_contains(good, false) THEN 'value'
    WHEN NOT coalesce(v[1] >= 1 AND v[1] = floor(v[1]), false) THEN 'tag' WHEN NOT coalesce(v[7] BETWEEN -360 AND 360, false) THEN 'tdrot'
    WHEN NOT coalesce(v[18] IN (0, 1), false) THEN 'fs1' END AS reason
  FROM cast_
)
"""
_MEANS = ", ".join(
    [f"CAST(CAST(round(avg({v}) FILTER (WHERE NOT isnan({v})), 12) AS FLOAT) AS DOUBLE) AS mean_{v}" for v in VALUES]
    + [
        f"CAST(CAST(round(CASE WHEN sqrt(avg(cos(radians({a})))*avg(cos(radians({a}))) + avg(sin(radians({a})))*avg(sin(radians({a})))) > 1e-6 THEN degrees(atan2(avg(sin(radians({a}))), avg(cos(radians({a}))))) END, 12) AS FLOAT) AS DOUBLE) AS mean_{a}, "
        f"CAST(CAST(round(sqrt(avg(cos(radians({a})))*avg(cos(radians({a}))) + avg(sin(radians({a})))*avg(sin(radians({a})))), 12) AS FLOAT) AS DOUBLE) AS spread_{a}"
        for a in ANGLES
    ]
)
_PER_KEY = f"""
WITH t AS (SELECT CAST(round(tomo) AS BIGINT) AS tomo, CAST(round(ref) AS BIGINT) AS ref, {", ".join(VALUES + ANGLES)} FROM dynamo_tbl),
e AS (SELECT tomo_id, count(*) AS n FROM vll GROUP BY 1),
j AS (SELECT t.*, coalesce(e.n, 0) AS n FROM t LEFT JOIN e ON t.tomo = e.tomo_id),
k AS (SELECT 'tomo' AS field, tomo AS key_value, * FROM j UNION ALL SELECT 'ref', ref, * FROM j)
SELECT field, key_value, count(*) AS n_rows, count(CASE WHEN n > 0 THEN 1 END) AS n_matched, CAST(sum(n) AS BIGINT) AS n_pairs, {_MEANS}
FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2
"""
_SPLIT_FILES = r"""
WITH cur AS (
  SELECT file_id, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified_at DESC NULLS LAST, file_id) AS k FROM particle_files WHERE NOT regexp_matches(path, '(^|/)[_.][^/]*$')) WHERE k = 1
), parts AS (SELECT file_id, regexp_split_to_array(content, '\r\n|\n|\r') AS l FROM cur WHERE content IS NOT NULL),
lines AS (SELECT file_id, trim(unnest(l), e' \t') AS s, generate_subscripts(l, 1) AS i FROM parts),
marked AS (SELECT *, sum(CASE WHEN starts_with(lower(s), 'data_') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b FROM lines WHERE s <> '' AND NOT starts_with(s, '#')),
chosen AS (SELECT file_id, coalesce(min(CASE WHEN lower(s) = 'data_particles' THEN b END), min(CASE WHEN lower(s) <> 'data_optics' THEN b END)) AS b FROM marked WHERE starts_with(lower(s), 'data_') GROUP BY 1),
own AS (SELECT m.* FROM marked m JOIN chosen USING (file_id, b)),
labels AS (SELECT file_id, regexp_extract(s, '^\S+') AS label, row_number() OVER (PARTITION BY file_id ORDER BY i) AS c FROM own WHERE starts_with(s, '_')),
heads AS (SELECT file_id, count(*) AS n, max(CASE WHEN label = '_tag' THEN c END) AS t, max(CASE WHEN label = '_rlnImageName' THEN c END) AS g FROM labels GROUP BY 1),
found AS (SELECT own.file_id, regexp_extract_all(s, '"[^"]*"|''[^'']*''|\S+') AS v FROM own WHERE NOT starts_with(s, '_') AND NOT starts_with(lower(s), 'data_') AND lower(s) <> 'loop_')
"""
_RECORDS = _SPLIT_FILES + r"""
SELECT DISTINCT CAST(v[t] AS BIGINT) AS tag, regexp_replace(v[g], '^["''](.*)["'']$', '\1') AS image_name FROM found JOIN heads USING (file_id) WHERE len(v) = n AND t IS NOT NULL AND g IS NOT NULL AND regexp_full_match(v[t], '[0-9]+')
"""
SQL = {
    "p2_found": _ORPHANS + "SELECT src_table, row_key FROM orphans",
    "p2_report": _ORPHANS
    + "SELECT src_table, strftime(t, '%Y-%m') AS period, count(*) AS n_orphans, count(CASE WHEN reason = 'missing' THEN 1 END) AS n_missing, count(CASE WHEN reason = 'late' THEN 1 END) AS n_late, count(CASE WHEN reason = 'deleted' THEN 1 END) AS n_deleted FROM orphans GROUP BY 1, 2",
    "p3_found": """
SELECT field, key_value FROM (
  SELECT 'tomo' AS field, CAST(round(tomo) AS BIGINT) AS key_value, count(*) AS n FROM dynamo_tbl GROUP BY 2
  UNION ALL SELECT 'ref', CAST(round(ref) AS BIGINT), count(*) FROM dynamo_tbl GROUP BY 2
) WHERE key_value IS NOT NULL AND n * 100 >= 3 * (SELECT count(*) FROM dynamo_tbl)""",
    "p3_per_key": _PER_KEY,
    "p5_found": _RECORDS,
    "p5_report": _SPLIT_FILES
    + r""", judged AS (SELECT len(v) <> n AS cut, t IS NULL OR g IS NULL AS lost, t IS NOT NULL AND NOT regexp_full_match(v[t], '[0-9]+') AS bad, v[t] AS tag, v[g] AS name FROM found JOIN heads USING (file_id)),
kept AS (SELECT CAST(tag AS BIGINT) AS tag, regexp_replace(name, '^["''](.*)["'']$', '\1') AS name FROM judged WHERE NOT cut AND NOT lost AND NOT bad),
c AS (SELECT (SELECT count(*) FROM parts) AS current_files, (SELECT count(*) FROM judged) AS rows_read, (SELECT count(*) FROM judged WHERE cut) AS cut, (SELECT count(*) FROM judged WHERE NOT cut AND lost) AS no_columns,
  (SELECT count(*) FROM judged WHERE NOT cut AND NOT lost AND bad) AS no_tag, (SELECT count(*) FROM kept) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS records)
SELECT item, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME item VALUE n)""",
    "p4_found": _LINES + "SELECT line_id FROM judged WHERE reason IS NOT NULL",
    "p4_reasons": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_rows": _LINES + "SELECT line_id, " + ", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(TBL_COLUMNS)) + " FROM judged WHERE reason IS NULL",
}
