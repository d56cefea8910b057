"""Range filter, down-sampling, grid predicates and crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.config import MapConfig
from voxmap.functions import f32, squared


def in_range(low: float, high: float, x: str = "px", y: str = "py", z: str = "pz") -> Column:
    """Bounds are inclusive; NaN passes."""
    d2 = squared(x, y, z)
    return F.isnan(d2) | d2.between(F.lit(float(low) * low), F.lit(float(high) * high))


def range_filter(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.where(in_range(low, high))


def every_nth(points: DataFrame, n: int) -> DataFrame:
    """The first, (n+1)-th, ... point of each frame in arrival order; no shuffle for n = 1."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    if n == 1:
        return points
    r = F.row_number().over(Window.partitionBy("frame_id").orderBy("point_idx")) - 1
    return points.withColumn("_r", r).where(F.col("_r") % n == 0).drop("_r")


def in_grid(cfg: MapConfig, x: Column, y: Column, z: Column) -> Column:
    """Strictly inside the configured bounds by one metre on all six faces; NaN fails."""
    ok = None
    for c, lo, hi in zip((x, y, z), cfg.low, cfg.high, strict=True):
        e = (c > f32(lo + 1)) & (c < f32(hi - 1)) & ~F.isnan(c)
        ok = e if ok is None else ok & e
    return ok


def kernel_fits(cfg: MapConfig, x: str = "wx", y: str = "wy", z: str = "wz") -> Column:
    s = f32(2 * cfg.radius * cfg.res)
    c = [F.col(v) for v in (x, y, z)]
    return in_grid(cfg, *[v - s for v in c]) & in_grid(cfg, *[v + s for v in c])


def crop_xy(points: DataFrame, m: float) -> DataFrame:
    return points.where((F.abs("wx") <= f32(m)) & (F.abs("wy") <= f32(m)))
