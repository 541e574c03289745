"""Rows with a volume each: sums by group, alignment to references. Volumes are little-endian float32 in `data` with nz, ny, nx."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoframe.functions import volume as v
from tomoframe.functions.columns import number
from tomoframe.functions.geometry import wedge_side
from tomoframe.session import written

#: References are broadcast in blocks of at most so many bytes, or of one.
BLOCK_BYTES = 1 << 28
#: Groups of partial sums, so that the sums of one large group are not all added up by one task.
SALTS = 32
_ROW = "row_of_particle"


def usable(volumes: DataFrame) -> DataFrame:
    """Rows whose data has the size that the shape asks for."""
    return volumes.where("data is not null and nz > 0 and ny > 0 and nx > 0 and octet_length(data) = 4 * cast(nz as bigint) * ny * nx")


def box(row) -> np.ndarray:
    return np.frombuffer(row.data, "<f4").reshape(row.nz, row.ny, row.nx)


def volume_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, nz, ny, nx, n and `total` (float64 bytes) of the volumes of each key and shape.

    Each task adds up its own rows, some tasks the sums of a share of the tasks, and the last ones those. Null keys are a
    group; rows without usable data don't count.
    """
    group = [*keys, "nz", "ny", "nx"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)
    schema = f"{names}, n bigint, total binary"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, n, total in zip(pdf[group].itertuples(index=False, name=None), pdf["n"], pdf["total"]):
                key = tuple(None if k is None or k != k else k for k in key)
                own = sums.setdefault(key, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(total, "<f8")
        yield pd.DataFrame([(*k, n, np.asarray(t, "<f8").tobytes()) for k, (n, t) in sums.items()], columns=[*group, "n", "total"])

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from add([pdf.assign(n=1, total=[np.frombuffer(d, "<f4").astype("<f8").tobytes() for d in pdf["data"]])])

    first = usable(rows).select(*group, "data").mapInPandas(widen, schema)
    salted = first.repartition(*group, F.pmod(F.spark_partition_id(), F.lit(SALTS))).mapInPandas(add, schema)
    return salted.repartition(*group).mapInPandas(add, schema)


def volume_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, nz, ny, nx, n and the mean as `data`."""

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[(np.frombuffer(t, "<f8") / n).astype("<f4").tobytes() for t, n in zip(pdf["total"], pdf["n"])])[[*keys, "nz", "ny", "nx", "n", "data"]]

    sums = volume_sums(rows, keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name != "total"] + ["data binary"])
    return sums.mapInPandas(divide, schema)


def statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with n_voxels, smallest, largest, mean and (population) std of each usable volume."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields] + ["n_voxels bigint, smallest double, largest double, mean double, std double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            boxes = [np.frombuffer(d, "<f4").astype(np.float64) for d in pdf["data"]]
            out = pdf[keep].copy()
            out["n_voxels"] = [b.size for b in boxes]
            for name, f in (("smallest", np.min), ("largest", np.max), ("mean", np.mean), ("std", np.std)):
                out[name] = [float(f(b)) for b in boxes]
            yield out

    return usable(rows).select(*dict.fromkeys([*keep, "data"])).mapInPandas(run, schema)


def aligned(rows: DataFrame, references: dict[int, np.ndarray], search: v.Search, keep: list[str], own_reference: bool = False, mask: np.ndarray | None = None) -> DataFrame:
    """Each volume's best pose over the references, and the volume brought back into the frame of that reference.

    rows: `keep`, nz, ny, nx, data; with `own_reference` also ref, cut to the range of the references, which is then the only
    one tried; optionally tdrot, tilt, narot as seeds and ftype, ymintilt, ymaxtilt, xmintilt, xmaxtilt as wedge. A wedge side of
    'auto' is resolved for each row by its fs1 and fs2; without these it is both.
    Returns `keep`, ref (the lowest of equal ones), the pose, cc, nz, ny, nx, data, and `error` where a volume can't be
    used; then the rest is null. References of another shape than the volume are passed over. Many or large references are tried
    in blocks, one after the other.
    """
    blocks = _blocks(references)
    if len(blocks) <= 1:
        return _aligned(rows, references, search, keep, own_reference, mask)
    rows = written(rows.withColumn(_ROW, F.monotonically_increasing_id()), "particles")
    if own_reference:
        first, last = min(references), max(references)
        own = F.least(F.greatest(F.coalesce(number("ref"), F.lit(float(first))).cast("bigint"), F.lit(first)), F.lit(last))
        parts = [_aligned(rows.where(own.isin(list(b))), b, search, [*keep, _ROW], True, mask) for b in blocks]
        return reduce(DataFrame.unionByName, parts).drop(_ROW)
    # Each block of references gives its best one; of these the best, of equal ones the lowest.
    all_parts = reduce(DataFrame.unionByName, [_aligned(rows, b, search, [*keep, _ROW], False, mask) for b in blocks])
    names = [c for c in all_parts.columns if c != _ROW]
    best = F.max_by(F.struct(*names), F.struct(F.col("error").isNull(), "cc", -F.col("ref")))
    return all_parts.groupBy(_ROW).agg(best.alias("b")).select("b.*")


def _blocks(references: dict[int, np.ndarray]) -> list[dict[int, np.ndarray]]:
    out: list[dict[int, np.ndarray]] = []
    size = 0
    for r in sorted(references):
        if not out or size + references[r].nbytes > BLOCK_BYTES:
            out.append({})
            size = 0
        out[-1][r] = references[r]
        size += references[r].nbytes
    return out


def _aligned(rows: DataFrame, references: dict[int, np.ndarray], search: v.Search, keep: list[str], own_reference: bool, mask: np.ndarray | None) -> DataFrame:
    """As `aligned`, with references that are broadcast together."""
    shared = rows.sparkSession.sparkContext.broadcast((references, mask))
    have = set(rows.columns)
    seeds = [c for c in ("tdrot", "tilt", "narot") if c in have]
    wedges = [c for c in ("ftype", "ymintilt", "ymaxtilt", "xmintilt", "xmaxtilt") if c in have]
    flags = [number(f) if f in have else F.lit(None).cast("double") for f in ("fs1", "fs2")]
    rows = rows.withColumn("_side", wedge_side(*flags, search.wedge_side.lower()))
    used = list(dict.fromkeys([*keep, "nz", "ny", "nx", "data", "_side", *(["ref"] if own_reference else []), *seeds, *wedges]))
    out_names = [*keep, "ref", *(("tdrot", "tilt", "narot", "dx", "dy", "dz", "cc")), "nz", "ny", "nx", "data", "error"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    schema = f"{kept}, ref bigint, tdrot double, tilt double, narot double, dx double, dy double, dz double, cc double, nz int, ny int, nx int, data binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, real_mask = shared.value
        known = lambda row, names: all(getattr(row, n) is not None and getattr(row, n) == getattr(row, n) for n in names)
        order = sorted(refs)
        for pdf in batches:
            out: list[tuple] = []
            alike: dict[tuple, list] = {}  # rows that are searched together: shape, seed, wedge, its side, references
            for side, values, row in zip(pdf["_side"], pdf[keep].itertuples(index=False, name=None), pdf.drop(columns="_side").itertuples(index=False)):
                try:
                    particle = box(row)
                except (ValueError, TypeError) as e:
                    out.append((*values, *[None] * 12, str(e)))
                    continue
                seed = tuple(float(getattr(row, s)) for s in seeds) if len(seeds) == 3 and known(row, seeds) else (0.0, 0.0, 0.0)
                lost = tuple(float(getattr(row, w)) for w in wedges) if len(wedges) == 5 and known(row, wedges) else None
                own = min(max(int(row.ref) if known(row, ["ref"]) else order[0], order[0]), order[-1]) if own_reference and order else None
                alike.setdefault((particle.shape, seed, lost, side, own), []).append((values, particle))
            for (shape, seed, lost, side, own), rows_ in alike.items():
                how = replace(search, wedge_side=side)
                support = None if lost is None else v.wedge(shape, int(lost[0]), *lost[1:])
                best: list[tuple | None] = [None] * len(rows_)
                for r in order if own is None else [own]:
                    if refs[r].shape != shape:
                        continue
                    step = max(1, v.BLOCK // refs[r].size)
                    for k in range(0, len(rows_), step):
                        for i, pose in enumerate(v.align_many([p for _, p in rows_[k : k + step]], refs[r], how, real_mask, seed, support), k):
                            if pose[6] == pose[6] and (best[i] is None or pose[6] > best[i][1][6]):
                                best[i] = (r, pose)
                for (values, particle), b in zip(rows_, best):
                    if b is None:
                        out.append((*values, *[None] * 12, "no reference of this shape"))
                        continue
                    back = v.aligned_back(particle, b[1])
                    back = back if real_mask is None else back * real_mask
                    out.append((*values, b[0], *b[1], *shape, back.astype("<f4").tobytes(), None))
            yield pd.DataFrame(out, columns=out_names)

    # A search takes far longer than its bytes suggest, so rows are spread over all cores however small they are.
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(*used).repartition(n, F.xxhash64(*keep)).mapInPandas(run, schema)
