"""Integration: stencil expansion, minimum rank (the AND of thermometer masks), saturating hits, occupancy.

(minimum rank, capped hits) is a commutative monoid, so partial aggregation is exact and maps merge exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.functions import direction_bin, f32
from voxmap.operators.cells import CELL
from voxmap.operators.filters import kernel_fits
from voxmap.operators.kernel import directions, occupied_sql, stencil_rows

VOXEL = ["ix", "iy", "iz"]


def _binned(points: DataFrame, cfg: MapConfig, *keep: str) -> DataFrame:
    """Points as (keep.., bin, bx, by, bz): direction and base voxel, the stencil's lowest corner."""
    step = f32(cfg.radius * cfg.res)
    base = [F.floor((F.col(w) - f32(o) - step) * f32(float(cfg.per_metre))).cast("int").alias(b) for w, o, b in zip(("wx", "wy", "wz"), cfg.origin, ("bx", "by", "bz"), strict=True)]
    b = direction_bin(*[F.col(f"w{a}") - F.col(f"s{a}") for a in "xyz"], cfg.bins_az, cfg.bins_el).alias("bin")
    return points.where(kernel_fits(cfg)).select(*keep, b, *base)


def hits(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """Points as (bin, bx, by, bz, n): equal direction and base voxel are counted before the stencil multiplies them."""
    return _binned(points, cfg).groupBy("bin", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"))


def resident_hits(points: DataFrame, cfg: MapConfig, resident: DataFrame) -> DataFrame:
    """hits() by resident cell, (bin, bx, by, bz, cx, cy, cz, n): the points whose frame may write to that cell.

    A point meets the cells of its stencil, not the voxels, and frames are gone before the stencil multiplies the rest.
    """
    last = resident.where("evict_frame is null").select(*CELL, "alloc_frame")
    p = _binned(points, cfg, "frame_id")
    for b, c in zip(("bx", "by", "bz"), CELL, strict=True):
        at = [F.floor((F.col(b) + k) / cfg.per_metre).cast("int") for k in (0, 2 * cfg.radius)]
        p = p.withColumn(c, F.explode(F.sequence(*at)))
    # the ring holds max_cells rows at most, however many points there are
    p = p.join(F.broadcast(last), CELL).where("frame_id >= alloc_frame")
    return p.groupBy("bin", "bx", "by", "bz", *CELL).agg(F.count(F.lit(1)).alias("n"))


def contributions(grouped: DataFrame, cfg: MapConfig) -> DataFrame:
    """(ix, iy, iz, rank, n): n hits, 0 for an offset in front of the surface."""
    spark = grouped.sparkSession
    r = cfg.radius
    cells = ", ".join(f"struct({x + r} as gx, {y + r} as gy, {z + r} as gz, {x} as ox, {y} as oy, {z} as oz, {r2} as r2, {k} as rank)" for _, x, y, z, r2, k, _ in stencil_rows(cfg))
    # bins_az * bins_el rows
    j = grouped.join(F.broadcast(directions(spark, cfg)), "bin")
    keep = [c for c in CELL if c in grouped.columns]
    e = j.selectExpr(*keep, "bx", "by", "bz", "n", "dx", "dy", "dz", f"inline(array({cells}))")
    return e.selectExpr(*keep, "bx + gx as ix", "by + gy as iy", "bz + gz as iz", "rank", f"n * {occupied_sql(cfg)} as n")


def fold(contrib: DataFrame, cfg: MapConfig) -> DataFrame:
    """The voxel map: ix, iy, iz, rank, hits, occupied."""
    a = contrib.groupBy(*VOXEL).agg(F.min("rank").alias("rank"), F.sum("n").alias("hits"))
    return finish(a, cfg)


def finish(a: DataFrame, cfg: MapConfig) -> DataFrame:
    n = cfg.occ_min_hits
    return a.select(*VOXEL, F.col("rank").cast("int").alias("rank"), F.least(F.lit(n), F.col("hits")).cast("int").alias("hits"), (F.col("hits") >= n).alias("occupied"))


def integrate(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """World points (wx..wz, sx..sz) to a voxel map."""
    return fold(contributions(hits(points, cfg), cfg), cfg)


def integrate_resident(points: DataFrame, cfg: MapConfig, resident: DataFrame) -> DataFrame:
    """As integrate(), but contributions to cells that are not allocated, or that are evicted later, are dropped."""
    c = contributions(resident_hits(points, cfg, resident), cfg)
    own = [F.floor(F.col(v) / cfg.per_metre).cast("int") == F.col(k) for k, v in zip(CELL, VOXEL, strict=True)]
    return fold(c.where(own[0] & own[1] & own[2]), cfg)


def merge(a: DataFrame, b: DataFrame, cfg: MapConfig) -> DataFrame:
    """Two maps as one; exact because capping is associative."""
    return finish(a.select(*VOXEL, "rank", "hits").unionByName(b.select(*VOXEL, "rank", "hits")).groupBy(*VOXEL).agg(F.min("rank").alias("rank"), F.sum("hits").alias("hits")), cfg)


def with_mask(voxels: DataFrame) -> DataFrame:
    """d: the 16-bit thermometer code of the rank."""
    return voxels.withColumn("d", F.expr("cast(shiftleft(1, rank) - 1 as int)"))
