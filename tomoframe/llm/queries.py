"""Queries of the problems of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.columns import whole
from tomoframe.llm.cutoff import Kept, keep_share
from tomoframe.llm.encode import encoded
from tomoframe.llm.langid import languages, passages
from tomoframe.llm.mixing import mixed, shares
from tomoframe.session import broadcast_if_small, table


def _kept(spark: SparkSession, folder: str) -> Kept:
    targets = table(spark, folder, "keep_targets").groupBy(F.col("ref").cast("double").alias("ref")).agg(F.max("keep_pct").alias("keep_pct"))
    rows = table(spark, folder, "dynamo_tbl").select("row_id", whole("tomo").alias("tomo"), "ref", "cc")
    scored = rows.join(broadcast_if_small(targets, cheap=True), "ref").withColumn("ref", F.col("ref").cast("int"))
    return keep_share(scored, ["tomo", "ref"], "cc", "row_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).rows.select("row_id")


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff and kept size of each source."""
    return _kept(spark, folder).cutoffs


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that were reached."""
    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of passages, other than the one that the label names."""
    other = F.col("declared").isNull() | (F.col("declared") != F.col("passage_lang"))
    return passages(table(spark, folder, "documents")).where(other).select("doc_id", "passage_lang").distinct()


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"))


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cutoffs, p6_ids, p7_mix, p7_shares, p8_found, p8_passages, p8_languages)}

_CUTOFFS = """
WITH r AS (
  SELECT row_id, CAST(round(tomo) AS BIGINT) AS tomo, CAST(d.ref AS INTEGER) AS ref, cc, keep_pct
  FROM dynamo_tbl d JOIN keep_targets k ON d.ref = k.ref WHERE tomo IS NOT NULL AND NOT isnan(tomo) AND cc IS NOT NULL AND NOT isnan(cc)
), n AS (
  SELECT *, count(*) OVER (PARTITION BY tomo, ref) AS n_rows, row_number() OVER (PARTITION BY tomo, ref ORDER BY cc DESC) AS place FROM r
), c AS (
  SELECT tomo, ref, keep_pct, n_rows, cc AS cutoff FROM n WHERE place = greatest(1, (n_rows * keep_pct + 99) // 100)
)
"""
SQL = {
    "p1_found": _CUTOFFS + "SELECT row_id FROM r JOIN c USING (tomo, ref) WHERE cc >= cutoff",
    "p1_cutoffs": _CUTOFFS + "SELECT tomo, ref, CAST(c.keep_pct AS BIGINT) AS keep_pct, n_rows, cutoff, count(*) AS n_kept FROM r JOIN c USING (tomo, ref) WHERE cc >= cutoff GROUP BY ALL",
}
