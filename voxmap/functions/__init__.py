"""Column expressions: float32 geometry, poses and direction bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def rotation(qw: str = "qw", qx: str = "qx", qy: str = "qy", qz: str = "qz") -> list[list[Column]]:
    """The 3 x 3 matrix of a quaternion in float32; unit norm is not enforced."""
    w, x, y, z = (f32(F.col(c)) for c in (qw, qx, qy, qz))
    two, one = f32(2.0), f32(1.0)
    tx, ty, tz = two * x, two * y, two * z
    return [
        [one - (ty * y + tz * z), tx * y - tz * w, tx * z + ty * w],
        [tx * y + tz * w, one - (tx * x + tz * z), ty * z - tx * w],
        [tx * z - ty * w, ty * z + tx * w, one - (tx * x + ty * y)],
    ]


def yaw_rotation(yaw: float) -> list[list[Column]]:
    c, s = math.cos(yaw), math.sin(yaw)
    return [[f32(c), f32(-s), f32(0.0)], [f32(s), f32(c), f32(0.0)], [f32(0.0), f32(0.0), f32(1.0)]]


def rpy_rotation(roll: float, pitch: float, yaw: float) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll), radians."""
    cr, sr, cp, sp, cy, sy = (f(v) for v in (roll, pitch, yaw) for f in (math.cos, math.sin))
    m = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return [[f32(v) for v in row] for row in m]


def apply_rotation(m: list[list[Column]], x: Column, y: Column, z: Column, t: list[Column]) -> list[Column]:
    return [r[0] * x + r[1] * y + r[2] * z + o for r, o in zip(m, t, strict=True)]


def squared(x: str, y: str, z: str) -> Column:
    a, b, c = (f32(F.col(v)) for v in (x, y, z))
    return (a * a + b * b + c * c).cast("double")


def direction_bin(dx: Column, dy: Column, dz: Column, bins_az: int, bins_el: int) -> Column:
    """bin = elevation bin * bins_az + azimuth bin; the zero vector is bin 0."""
    x, y, z = (c.cast("double") for c in (dx, dy, dz))
    n = F.sqrt(x * x + y * y + z * z)
    az = F.atan2(y, x)
    az = F.when(az < 0, az + F.lit(2 * math.pi)).otherwise(az)
    el = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / F.when(n > 0, n))))
    clamp = lambda v, k: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor(v).cast("int")))
    baz = clamp(az * F.lit(bins_az / (2 * math.pi)), bins_az)
    bel = clamp((el + F.lit(math.pi / 2)) * F.lit(bins_el / math.pi), bins_el)
    return F.when(n > 0, bel * bins_az + baz).otherwise(F.lit(0))
