"""Kernels as Arrow functions on columns, and candidate lists as table functions.

A volume column is binary (little-endian float32, z, y, x) beside its shape columns nz, ny, nx. Null or cut data gives null.

    spark.udtf.register("shift_candidates", shift_candidates)
    spark.sql("select * from shift_candidates(2, 'ellipsoid')")
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomoframe.functions import volume as v

SHAPE = ("nz", "ny", "nx")


def _box(data: bytes, shape: tuple[int, ...]) -> np.ndarray | None:
    if data is None or any(s is None or s != s for s in shape) or len(data) != 4 * int(np.prod(shape)):
        return None
    return np.frombuffer(data, "<f4").reshape([int(s) for s in shape])


def _mapped(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """f(volume, numbers...) as a function of the data column and number columns; a null number gives null."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, nz: pd.Series, ny: pd.Series, nx: pd.Series, *numbers: pd.Series) -> pd.Series:
        out = []
        for row in zip(data, nz, ny, nx, *numbers):
            box, rest = _box(row[0], row[1:4]), row[4:]
            out.append(None if box is None or any(x is None or x != x for x in rest) else np.asarray(f(box, *map(float, rest)), "<f4").tobytes())
        return pd.Series(out, dtype=object)

    return lambda data, *numbers: run(data, *SHAPE, *numbers)


#: rotate(data, tdrot, tilt, narot), shift(data, dx, dy, dz), inverse_transform(data, tdrot, tilt, narot, dx, dy, dz),
#: apply_wedge(data, ftype, ymin, ymax, xmin, xmax), lowpass(data, angstrom, pixel), symmetrise(data, n)
rotate = _mapped(lambda b, *a: v.turned(b, v.rotation(*a)))
shift = _mapped(lambda b, *d: v.shifted(b, d))
inverse_transform = _mapped(lambda b, *pose: v.aligned_back(b, pose))
apply_wedge = _mapped(lambda b, ftype, *tilts: v.filtered(b, v.wedge(b.shape, int(ftype), *tilts)))
lowpass = _mapped(lambda b, angstrom, pixel: v.low_passed(b, angstrom, pixel))
symmetrise = _mapped(lambda b, n: v.symmetrised(b, f"c{int(n)}"))


def _scored(f: Callable[[np.ndarray, np.ndarray], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, nz: pd.Series, ny: pd.Series, nx: pd.Series) -> pd.Series:
        out = []
        for p, q, *shape in zip(a, b, nz, ny, nx):
            x, y = _box(p, tuple(shape)), _box(q, tuple(shape))
            out.append(None if x is None or y is None else f(x, y))
        return pd.Series(out, dtype="float64")

    return lambda a, b: run(a, b, *SHAPE)


ncc = _scored(v.ncc)
local_ncc = _scored(v.local_ncc)


@F.udtf(returnType="dx int, dy int, dz int")
class shift_candidates:
    def eval(self, radius: int, mode: str):
        yield from v.shift_list(radius, mode)


@F.udtf(returnType="tdrot double, tilt double, narot double")
class angle_candidates:
    def eval(self, cone: float, cone_step: float, inplane: float, inplane_step: float):
        yield from v.angle_list(float(cone), float(cone_step), float(inplane), float(inplane_step))
