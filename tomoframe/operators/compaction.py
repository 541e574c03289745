"""Very many small STAR files made into few files of good size, with every current record once.

The current state of each path is found on its keys alone; only its content is then parsed. Records are written once,
range-partitioned by the clustering keys at boundaries that Spark samples, into as many sorted files as the target size
asks for. Before the new folder takes the place of the old one, everything is reconciled: the files read with the current files, the
rows of the source with records, duplicates and rows left out, the records written with these records.

A null path or content holds no records; a row with fewer values than columns was cut off and is left out; a tag that is no
whole number makes no record, nor does a null image name. Equal records, in one file or in several, are one record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.session import file_system, new_folder, written
from tomoframe.sources.star import particles

TARGET_BYTES = 128 * 1024 * 1024
#: What becomes of a row of a file: it is one row for each file read, a record, or left out because it was cut off, its file has
#: no such columns, or its tag is no whole number.
FILE, RECORD, CUT, NO_COLUMNS, NO_TAG = "file", "record", "cut", "no columns", "no tag"


def current_files(files: DataFrame) -> DataFrame:
    """The rows of `files` (file_id, path, modified_at, content) that are the current state of their path.

    The latest modified_at counts, of equal ones the smallest file_id. Files whose base name begins with _ or . are no
    data. Content isn't looked at: it is joined to the chosen ids afterwards, so that a path with very many states is small.
    """
    named = files.where("path is not null and not regexp(path, '(^|/)[_.][^/]*$')")
    newest = named.groupBy("path").agg(F.max(F.struct(F.coalesce(F.col("modified_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), (-F.col("file_id")).alias("id"))).alias("m")).select((-F.col("m.id")).alias("file_id"))
    return files.where("content is not null").join(newest, "file_id", "left_semi")


def _tag(value: str) -> int | None:
    try:
        tag = int(value)
    except ValueError:
        try:
            tag = int(x) if (x := float(value)) == int(x) else None
        except (ValueError, OverflowError):
            return None
    return tag if tag is not None and -(2**63) <= tag < 2**63 else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, tags, names = [], [], []

        def add(kind: str, tag: int | None = None, name: str | None = None, kinds=kinds, tags=tags, names=names) -> None:
            kinds.append(kind)
            tags.append(tag)
            names.append(name)

        for content in batch.column(0).to_pylist():
            block = particles(content)
            add(FILE)
            for _ in range(block.n_cut):
                add(CUT)
            if "_tag" not in block.columns or "_rlnImageName" not in block.columns:
                for _ in block.rows:
                    add(NO_COLUMNS)
                continue
            i, j = block.columns.index("_tag"), block.columns.index("_rlnImageName")
            for row in block.rows:
                tag = _tag(row[i])
                if tag is None:
                    add(NO_TAG)
                else:
                    add(RECORD, tag, row[j])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tags, pa.int64()), pa.array(names, pa.string())], names=["kind", "tag", "image_name"])


@dataclass(frozen=True)
class Consolidated:
    """rows: the records (tag BIGINT, image_name STRING), from the few files in which they now are. counts: current_files,
    rows_read (of their particle blocks), of these cut, no_columns, no_tag and duplicates, and records, the rest."""

    rows: DataFrame
    counts: dict[str, int]


def consolidated(files: DataFrame, target_bytes: int = TARGET_BYTES, folder: str | None = None) -> Consolidated:
    """The records of the current files in few files in `folder`; without one in a folder of the session."""
    current = current_files(files)
    parsed = written(current.select("content").mapInArrow(_parsed, "kind string, tag bigint, image_name string"), "parsed")
    kinds = {r["kind"]: r["n"] for r in parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_files, n_current = kinds.pop(FILE, 0), current.count()
    if n_files != n_current:
        raise RuntimeError(f"{n_files} files were read, {n_current} are current")
    records = written(parsed.where(F.col("kind") == RECORD).groupBy("tag", "image_name").agg(F.count(F.lit(1)).alias("n_copies")), "records")
    n, copies = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_copies"), F.lit(0))).first()
    if copies != kinds.get(RECORD, 0):
        raise RuntimeError(f"{copies} records were counted, {kinds.get(RECORD, 0)} were read")
    counts = {"current_files": n_files, "rows_read": sum(kinds.values()), **{k.replace(" ", "_"): kinds.get(k, 0) for k in (CUT, NO_COLUMNS, NO_TAG)}, "duplicates": copies - n, "records": n}
    folder = folder or new_folder(files.sparkSession, "particles")
    return Consolidated(compact(records.select("tag", "image_name"), ["tag", "image_name"], folder, target_bytes, staged=True), counts)


def _summary(rows: DataFrame) -> tuple:
    """How many rows there are, the sum of their hashes, and their bytes: strings by their own, 8 for the rest."""
    size = sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8)) for f in rows.schema.fields)
    r = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.sum(size)).first()
    return r[0], r[1], r[2] or 0


def _rename(fs, source, to) -> bool:
    return fs.rename(source, to)


def _recover(spark: SparkSession, folder: str) -> list:
    """The folders that earlier runs moved aside and left. If `folder` is missing, the latest of them is put back: a run ended
    between the two renames."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at.getParent()):
        return []
    left = [s for s in fs.listStatus(at.getParent()) if s.getPath().getName().startswith(f"{at.getName()}.old-")]
    left = [s.getPath() for s in sorted(left, key=lambda s: s.getModificationTime())]
    if left and not fs.exists(at) and not _rename(fs, left.pop(), at):
        raise RuntimeError(f"{folder} is missing and can't be put back from what was moved aside")
    return left


def _swap(spark: SparkSession, fresh: str, folder: str, left: list) -> None:
    """`fresh` takes the place of `folder`; if it can't, `folder` is as it was."""
    fs, at = file_system(spark, folder)
    _, new = file_system(spark, fresh)
    _, aside = file_system(spark, f"{folder}.old-{uuid.uuid4().hex}")
    there = fs.exists(at)
    if there and not _rename(fs, at, aside):
        raise RuntimeError(f"{folder} can't be moved aside; it is unchanged")
    if not _rename(fs, new, at):
        if there and not _rename(fs, aside, at):
            raise RuntimeError(f"{fresh} can't be renamed, and {folder} is now {aside.toString()}")
        raise RuntimeError(f"{fresh} can't be renamed; {folder} is unchanged")
    for old in [*left, aside]:
        fs.delete(old, True)


def compact(rows: DataFrame, keys: list[str], folder: str, target_bytes: int = TARGET_BYTES, staged: bool = False) -> DataFrame:
    """Writes `rows` sorted by `keys` into files of about `target_bytes` (uncompressed) in `folder` and returns them read back.

    The new files go to a folder beside it, are counted and summed up there, and only then renamed; a mismatch or a rename that
    fails raises and leaves `folder` as it was. An existing folder is moved aside and deleted last; if a run ends in between, the
    next one puts it back first. No rows make one empty file. `staged` rows are read from a table that doesn't change.
    """
    spark: SparkSession = rows.sparkSession
    left = _recover(spark, folder)
    rows = rows if staged else written(rows, "records")
    before = _summary(rows)
    n = max(1, -(-before[2] // target_bytes))
    fresh = f"{folder}.new-{uuid.uuid4().hex}"
    try:
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(fresh)
        after = _summary(spark.read.schema(rows.schema).parquet(fresh))
        if before[:2] != after[:2]:
            raise RuntimeError(f"{after[0]} rows were written instead of {before[0]}, or others; {folder} is unchanged")
        _swap(spark, fresh, folder, left)
    finally:
        fs, new = file_system(spark, fresh)
        fs.delete(new, True)
    return spark.read.schema(rows.schema).parquet(folder)
