"""Point lookup, row walks and trilinear interpolation; unallocated voxels read as rank 16, hits 255, free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.functions import f32
from voxmap.operators.filters import in_grid
from voxmap.operators.integrate import VOXEL


def voxel_index(cfg: MapConfig, x, axis: int):
    return F.floor((f32(x) - f32(cfg.origin[axis])) * f32(float(cfg.per_metre))).cast("int")


def _read(rows: DataFrame, voxels: DataFrame) -> DataFrame:
    v = voxels.select(*[F.col(c).alias(f"_{c}") for c in VOXEL], F.col("rank").alias("_rank"), F.col("hits").alias("_hits"), F.col("occupied").alias("_occ"))
    on = [F.col(c) == F.col(f"_{c}") for c in VOXEL]
    return rows.join(v, on[0] & on[1] & on[2], "left").withColumns({"rank": F.coalesce("_rank", F.lit(16)), "hits": F.coalesce("_hits", F.lit(255)), "occupied": F.coalesce("_occ", F.lit(False))}).drop(*[f"_{c}" for c in VOXEL], "_rank", "_hits", "_occ")


def lookup(probes: DataFrame, voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    return _read(probes.select("probe_id", *[voxel_index(cfg, F.col(a), i).alias(v) for i, (a, v) in enumerate(zip("xyz", VOXEL, strict=True))]), voxels)


def walk(probes: DataFrame, voxels: DataFrame, cfg: MapConfig, n: int) -> DataFrame:
    """n voxels in +x from each probe."""
    p = probes.select("probe_id", *[voxel_index(cfg, F.col(a), i).alias(v) for i, (a, v) in enumerate(zip("xyz", VOXEL, strict=True))])
    return _read(p.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("ix", F.col("ix") + F.col("step")), voxels)


def trilinear(probes: DataFrame, voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    """a0..a7 on the ranks of the 8 voxels at and beyond the probe, and the interpolated value; zeros outside the grid.

    The cell origin is the floor on the lattice. One join reads all corners of all probes.
    """
    p = probes.select("probe_id", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[voxel_index(cfg, F.col(a), i).alias(f"i{a}") for i, a in enumerate("xyz")], in_grid(cfg, *[f32(F.col(a)) for a in "xyz"]).alias("inside"))
    corners = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(i & 1).alias("ux"), F.lit(i >> 1 & 1).alias("uy"), F.lit(i >> 2).alias("uz")) for i in range(8)])
    e = p.where("inside").withColumn("k", F.explode(corners)).select("probe_id", F.col("k.c").alias("c"), *[(F.col(f"i{a}") + F.col(f"k.u{a}")).alias(f"i{a}") for a in "xyz"])
    got = _read(e, voxels).groupBy("probe_id").agg(*[F.max(F.when(F.col("c") == i, F.col("rank"))).cast("double").alias(f"c{i}") for i in range(8)])
    j = p.join(got, "probe_id", "left")
    inv, c = float(cfg.per_metre), [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(8)]
    u = {a: (F.col(a) - (F.col(f"i{a}") / inv + float(cfg.origin[i]))) * inv for i, a in enumerate("xyz")}
    # coefficients in the unit cell
    a = [c[0], c[1] - c[0], c[2] - c[0], c[4] - c[0], c[3] - c[1] - c[2] + c[0], c[5] - c[1] - c[4] + c[0], c[6] - c[2] - c[4] + c[0], c[7] - c[3] - c[5] - c[6] + c[1] + c[2] + c[4] - c[0]]
    t = [F.lit(1.0), u["x"], u["y"], u["z"], u["x"] * u["y"], u["x"] * u["z"], u["y"] * u["z"], u["x"] * u["y"] * u["z"]]
    value = sum((x * y for x, y in zip(a[1:], t[1:], strict=True)), a[0])
    return j.select("probe_id", *[x.alias(f"a{i}") for i, x in enumerate(a)], F.when(F.col("inside"), value).otherwise(0.0).alias("value"))
