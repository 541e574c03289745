"""Angles, poses, boxes and candidates as column expressions. Angles are in degrees, conventions ZXZ (tdrot, tilt, narot) and ZYZ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def wrapped(angle: Column) -> Column:
    """The same direction above -180 up to 180."""
    a = F.pmod(angle, F.lit(360.0))
    return F.when(a > 180, a - 360).otherwise(a)


def zxz_to_zyz(tdrot: Column, tilt: Column, narot: Column, transposed: bool = False) -> tuple[Column, Column, Column]:
    """rot, tilt, psi of the same rotation matrix, or of the transposed one."""
    if transposed:
        return wrapped(90 - narot), tilt, wrapped(-90 - tdrot)
    return wrapped(tdrot - 90), tilt, wrapped(narot + 90)


def zyz_to_zxz(rot: Column, tilt: Column, psi: Column, transposed: bool = False) -> tuple[Column, Column, Column]:
    if transposed:
        return wrapped(-90 - psi), tilt, wrapped(90 - rot)
    return wrapped(rot + 90), tilt, wrapped(psi - 90)


def _z(angle: Column) -> Matrix:
    c, s, o, i = F.cos(F.radians(angle)), F.sin(F.radians(angle)), F.lit(0.0), F.lit(1.0)
    return [[c, -s, o], [s, c, o], [o, o, i]]


def _x(angle: Column) -> Matrix:
    c, s, o, i = F.cos(F.radians(angle)), F.sin(F.radians(angle)), F.lit(0.0), F.lit(1.0)
    return [[i, o, o], [o, c, -s], [o, s, c]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[reduce(lambda p, q: p + q, (a[i][k] * b[k][j] for k in range(3))) for j in range(3)] for i in range(3)]


def zxz_matrix(tdrot: Column, tilt: Column, narot: Column) -> Matrix:
    """Rz(tdrot) Rx(tilt) Rz(narot)."""
    return product(product(_z(tdrot), _x(tilt)), _z(narot))


def matrix_to_zxz(m: Matrix) -> tuple[Column, Column, Column]:
    """tdrot, tilt, narot of a rotation matrix; at tilt 0 and 180 narot is 0. What depends on a null is null."""
    tilt = F.when(m[2][2].isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[2][2])))))
    pole = F.abs(m[2][2]) > 1 - 1e-9
    tdrot = F.when(pole, F.degrees(F.atan2(m[1][0], m[0][0]))).otherwise(F.degrees(F.atan2(m[0][2], -m[1][2])))
    return tdrot, tilt, F.when(pole, F.lit(0.0)).otherwise(F.degrees(F.atan2(m[2][0], m[2][1])))


def composed(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The ZXZ angles of the product of two rotations."""
    return matrix_to_zxz(product(zxz_matrix(*first), zxz_matrix(*second)))


def to_centred(position: Column, size: Column | float, pixel: Column | float) -> Column:
    """Voxels from the corner as Angstrom from the centre."""
    return (position - size / 2) * pixel


def from_centred(centred: Column, size: Column | float, pixel: Column | float) -> Column:
    return centred / pixel + size / 2


def crop_box(position: Column, side: int, size: Column | int) -> dict[str, Column]:
    """One axis of a cube around a 1-based position: the voxels lo..hi that exist, the ideal bounds, and whether they differ."""
    p = F.floor(position)
    half = side / 2
    size = F.lit(size) if isinstance(size, int) else size
    lo = F.ceil(F.greatest(F.lit(1.0), p - half))
    hi = F.floor(F.least(size.cast("double"), p + half - 1))
    ideal_lo, ideal_hi = F.ceil(p - half), F.floor(p + half - 1)
    return {"lo": lo, "hi": hi, "ideal_lo": ideal_lo, "ideal_hi": ideal_hi, "outside": (lo != ideal_lo) | (hi != ideal_hi)}


def embed_box(position: Column, side: int, size: Column | int) -> dict[str, Column]:
    """One axis of a box that is added to a volume around a 0-based position, rounded half to even: bounds in the volume and in the box."""
    size = F.lit(size) if isinstance(size, int) else size
    start = F.rint(position).cast("bigint") - side // 2
    lo = F.greatest(F.lit(0).cast("bigint"), start)
    hi = F.least(size.cast("bigint"), start + side)
    return {"lo": lo, "hi": hi, "box_lo": lo - start, "box_hi": hi - start, "empty": hi <= lo}


def aperture(lo: Column, hi: Column) -> Column:
    """The width of a range: hi where lo is 0, else |hi - lo|, from 0 to 360."""
    return F.greatest(F.lit(0.0), F.least(F.lit(360.0), F.when(lo == 0, hi).otherwise(F.abs(hi - lo))))


def window_around(angle: Column, margin: Column | float) -> tuple[Column, Column]:
    """From margin below an angle to margin + 1 above it, modulo 360; the whole circle where that wraps around."""
    lo, hi = F.pmod(angle - margin, F.lit(360.0)), F.pmod(angle + margin + 1, F.lit(360.0))
    return F.when(lo > hi, 0.0).otherwise(lo), F.when(lo > hi, 360.0).otherwise(hi)


def wedge_side(fs1: Column, fs2: Column, asked: str = "auto") -> Column:
    """Which side the missing wedge is applied to: as asked, else by the table's two flags."""
    if asked != "auto":
        return F.lit(asked)
    return F.when((fs1 > 0) & (fs2 <= 0), "particle").when((fs2 > 0) & (fs1 <= 0), "template").otherwise("both")


def scan(lo: Column, hi: Column, step: Column, with_end: bool = False) -> Column:
    """lo, lo + step, ... below hi (or up to it), as an array; reversed bounds are swapped; a step that isn't positive gives lo alone."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    n = F.floor((b - a) / step + 1e-9) if with_end else F.ceil((b - a) / step - 1e-9) - 1
    last = F.when(step > 0, F.greatest(F.lit(0).cast("bigint"), n)).otherwise(F.lit(0).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: a + i * step)


def in_shift_range(mode: Column, shift: tuple[Column, Column, Column], r: Column, centre: tuple[Column, Column, Column]) -> Column:
    """Whether an integer shift within a cube of radius r around `centre` is a candidate. The ellipsoid and the cylinder
    along z lie around the centre ('..._follow'), or around zero ('..._center'); 'center_only' is no shift at all."""
    low = F.lower(mode)
    x, y, z = (F.when(low.endswith("_center"), c + s).otherwise(s) for s, c in zip(shift, centre, strict=True))
    any_r = r <= 0
    return (
        F.when(low.startswith("ellipsoid"), any_r | (x * x + y * y + z * z <= r * r))
        .when(low.startswith("cylinder_z"), any_r | (x * x + y * y <= r * r))
        .when(low == "center_only", (shift[0] == 0) & (shift[1] == 0) & (shift[2] == 0))
        .otherwise(F.lit(True))
    )


def ring_size(tilt: Column, spacing: Column) -> Column:
    """How many axes stand on the ring at `tilt`. Two axes of a ring whose azimuths differ by a have 1 - sin(tilt)^2 (1 - cos(a))
    as the cosine of the angle between them; neighbours are `spacing` apart, or opposite where the ring is smaller than that.
    Fixed values: two axes more than fit into the ring, and one at a pole."""
    radius = F.sin(F.radians(tilt))
    between = F.degrees(F.acos(F.greatest(F.lit(-1.0), 1 - (1 - F.cos(F.radians(spacing))) / (radius * radius))))
    fit = F.when((tilt == 0) | (tilt == 180), -1).when(between > 0, F.floor(360.0 / between)).otherwise(-1)
    return (fit + 2).cast("bigint")


def in_wedge(ftype: Column, kx: Column, ky: Column, kz: Column, ymin: Column, ymax: Column, xmin: Column, xmax: Column) -> Column:
    """Whether a frequency is measured: tilt about y (1), about x (2), both (4), a cone (3), or all (0 and others)."""
    tiny = 1e-12
    about_y = F.degrees(F.atan2(F.abs(ky) + tiny, F.abs(kz) + tiny))
    about_x = F.degrees(F.atan2(F.abs(kx) + tiny, F.abs(kz) + tiny))
    cone = F.degrees(F.atan2(F.sqrt(kx * kx + ky * ky + tiny), F.abs(kz) + tiny))
    in_y, in_x = (about_y >= ymin) & (about_y <= ymax), (about_x >= xmin) & (about_x <= xmax)
    return F.when(ftype == 1, in_y).when(ftype == 2, in_x).when(ftype == 3, (cone >= ymin) & (cone <= ymax)).when(ftype == 4, in_y & in_x).otherwise(F.lit(True))


def parabola_offset(left: Column, peak: Column, right: Column) -> Column:
    """Where the parabola through three neighbours has its top, from -1 to 1; 0 if they are flat."""
    bend = left - 2 * peak + right
    return F.when(F.abs(bend) < 1e-8, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (left - right) / 2 / bend)))
