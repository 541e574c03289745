"""What every operator needs of the session: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it has been measured to hold at most so many bytes.
BROADCAST_BYTES = 64 << 20

_own_folders: dict[str, str] = {}
_open_blocks: list[list[str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own.

    On a cluster without that setting this raises, since a machine-local folder would lose data.
    """
    set_by_user = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_user:
        return set_by_user.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        own = tempfile.mkdtemp(prefix="tomoframe-")
        atexit.register(shutil.rmtree, own, True)
        _own_folders[app] = f"file://{own}"
    return _own_folders[app]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        fs, at = file_system(spark, path)
        fs.delete(at, True)
    except Exception:  # the session has ended before us
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What the operators write in between, inside this block, goes when it ends. Results must have been written by then."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.remove(made)
        for path in made:
            _drop(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name not used before in the shared folder. What is written there goes at the end of the innermost `scratch` block, or
    without one when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    else:
        atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: it cuts lineage and outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.StructType):
        return sum((_size(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + _size(x, kind.elementType)), F.lit(0)) + 16
        return F.coalesce(F.array_size(c), F.lit(0)).cast("bigint") * 8 + 16
    if isinstance(kind, T.MapType):
        return _size(F.map_keys(c), T.ArrayType(kind.keyType)) + _size(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(8).cast("bigint")


def measured(df: DataFrame) -> int:
    """About how many bytes the rows of `df` take in memory, by their own strings and arrays."""
    row = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("bigint"))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES, cheap: bool = False) -> DataFrame:
    """A broadcast hint for `df` if it has been measured to hold at most `most` bytes, else `df` without one. It is written
    first, so that it is computed once; not if it is `cheap`: read from a small table or from one written before."""
    side = df if cheap else written(df, "side")
    return F.broadcast(side) if measured(side) <= most else side


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores, before work that takes far longer than its bytes suggest;
    unchanged, without a shuffle, where the scan already gives that many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
