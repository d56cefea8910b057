"""The directional kernel as two small tables: a stencil with ranks, and the direction of each bin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from voxmap.config import MapConfig


def stencil_rows(cfg: MapConfig) -> list[tuple[int, int, int, int, int, int, int]]:
    """(k, ox, oy, oz, r2, rank, mask); z slowest, x fastest."""
    r = cfg.radius
    off = [(x, y, z) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    order = {v: i for i, v in enumerate(sorted({x * x + y * y + z * z for x, y, z in off}))}
    out = []
    for k, (x, y, z) in enumerate(off):
        r2 = x * x + y * y + z * z
        rank = min(16, order[r2] if cfg.distance_mode == "L2" else abs(x) + abs(y) + abs(z))
        out.append((k, x, y, z, r2, rank, (1 << rank) - 1))
    return out


def bin_directions(cfg: MapConfig) -> np.ndarray:
    """float32 unit vectors of the bin centres, row = elevation bin * bins_az + azimuth bin."""
    f = np.float32
    az = (np.arange(cfg.bins_az, dtype=f) + f(0.5)) * f(2 * np.pi / cfg.bins_az)
    el = f(-np.pi / 2) + (np.arange(cfg.bins_el, dtype=f) + f(0.5)) * f(np.pi / cfg.bins_el)
    e, a = np.meshgrid(el, az, indexing="ij")
    return np.stack([np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)], axis=-1).reshape(-1, 3).astype(f)


def stencil(spark: SparkSession, cfg: MapConfig) -> DataFrame:
    return spark.createDataFrame(stencil_rows(cfg), "k int, ox int, oy int, oz int, r2 int, rank int, mask int")


def rank_table(spark: SparkSession, cfg: MapConfig) -> DataFrame:
    """(r2, rank, mask) of each squared distance of the L2 stencil."""
    return stencil(spark, cfg).select("r2", "rank", "mask").distinct()


def directions(spark: SparkSession, cfg: MapConfig) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(bin_directions(cfg))], "bin int, dx float, dy float, dz float")


def kernel(spark: SparkSession, cfg: MapConfig) -> DataFrame:
    """The full bank: sign 0 marks the hit and the half-space behind it within the shadow radius."""
    s = stencil(spark, cfg).crossJoin(directions(spark, cfg))
    return s.selectExpr("bin", "k", "ox", "oy", "oz", "rank", "mask", occupied_sql(cfg) + " as occ").selectExpr("*", "1 - occ as sign")


def occupied_sql(cfg: MapConfig, o: str = "", d: str = "") -> str:
    dot = " + ".join(f"{d}d{a} * cast({o}o{a} as float)" for a in "xyz")
    return f"case when {o}r2 = 0 or ({dot} >= cast(0 as float) and {o}r2 <= {cfg.shadow_radius**2}) then 1 else 0 end"


def preview(spark: SparkSession, cfg: MapConfig, bin_: int) -> DataFrame:
    """The z = 0 slice of one bin."""
    return kernel(spark, cfg).where(f"bin = {int(bin_)} and oz = 0").orderBy("oy", "ox")
