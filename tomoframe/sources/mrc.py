"""Volumes in the MRC format: a header of 1024 bytes, an extended header, then the voxels."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.schema import VOLUME

HEADER = 1024
# The kinds of voxels by mode.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def header(raw: bytes) -> dict:
    """Shape, mode, byte order, place of the voxels and voxel size (0: not known) of a header."""
    if len(raw) < HEADER:
        raise ValueError("no header")
    order = ">" if raw[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack(order + "4i", raw[:16])
    mx, cell = struct.unpack(order + "i", raw[28:32])[0], struct.unpack(order + "f", raw[40:44])[0]
    extended = struct.unpack(order + "i", raw[92:96])[0]
    if mode not in MODES or min(nx, ny, nz) <= 0 or extended < 0:
        raise ValueError(f"mode {mode}, shape {(nz, ny, nx)}")
    return {"shape": (nz, ny, nx), "dtype": np.dtype(order + MODES[mode]), "start": HEADER + extended, "voxel_size": cell / mx if mx > 0 else 0.0}


def decode(raw: bytes) -> tuple[np.ndarray, float]:
    """The volume as float32, and its voxel size; raises ValueError for a cut or foreign file."""
    h = header(raw)
    n = int(np.prod(h["shape"]))
    if len(raw) < h["start"] + n * h["dtype"].itemsize:
        raise ValueError("cut off")
    return np.frombuffer(raw, h["dtype"], n, h["start"]).reshape(h["shape"]).astype(np.float32), h["voxel_size"]


def encode(vol: np.ndarray, voxel_size: float = 0.0) -> bytes:
    vol = np.ascontiguousarray(vol, "<f4")
    nz, ny, nx = vol.shape
    raw = bytearray(HEADER)
    raw[0:16] = struct.pack("<4i", nx, ny, nz, 2)
    raw[28:40] = struct.pack("<3i", nx, ny, nz)
    raw[40:64] = struct.pack("<6f", nx * voxel_size, ny * voxel_size, nz * voxel_size, 90, 90, 90)
    raw[64:76] = struct.pack("<3i", 1, 2, 3)
    raw[76:88] = struct.pack("<3f", *(map(float, (vol.min(), vol.max(), vol.mean())) if vol.size else (0, 0, 0)))
    raw[208:212], raw[212:216] = b"MAP ", b"\x44\x44\x00\x00"
    return bytes(raw) + vol.tobytes()


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path` of each *.mrc or *.mrcs file below a folder or several; the files aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{mrc,mrcs}").option("recursiveFileLookup", "true").load(path).select("path")


def read_volumes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per *.mrc or *.mrcs file below `path`, with the columns of VOLUME and `error` where a file can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mrc,mrcs}").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    vol, size = decode(raw)
                    rows.append((p, *vol.shape, size or None, vol.astype("<f4").tobytes(), None))
                except ValueError as e:
                    rows.append((p, None, None, None, None, None, str(e)))
            yield type(pdf)(rows, columns=[*VOLUME.fieldNames(), "error"])

    return files.select("path", "content").mapInPandas(run, "path string, nz int, ny int, nx int, voxel_size double, data binary, error string")


def write_volumes(volumes: DataFrame, folder: str) -> None:
    """Each row (path, nz, ny, nx, voxel_size, data) as a file of that base name in `folder`, which all executors must share.
    A file is written under another name and then renamed, so that a task that runs twice does no harm."""

    def run(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            to = os.path.join(folder, os.path.basename(r["path"]))
            part = f"{to}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(encode(np.frombuffer(r["data"], "<f4").reshape(r["nz"], r["ny"], r["nx"]), r["voxel_size"] or 0.0))
            os.replace(part, to)

    volumes.where(F.col("data").isNotNull()).select(*VOLUME.fieldNames()).foreachPartition(run)
