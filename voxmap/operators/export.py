"""Read-out: surface cloud, dense cells, occupied centres, and the file writers at the edge."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.operators.integrate import VOXEL

LATTICE = ["cz", "cy", "cx", "vz", "vy", "vx"]


def cells(voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    """Cell (cx, cy, cz) and place in it (vx, vy, vz)."""
    m = cfg.per_metre
    return voxels.withColumns({f"c{a}": F.expr(f"i{a} div {m}").cast("int") for a in "xyz"}).withColumns({f"v{a}": F.expr(f"i{a} % {m}") for a in "xyz"})


def centre(cfg: MapConfig, axis: int, index: str):
    return ((F.col(index) + 0.5) / float(cfg.per_metre) + float(cfg.origin[axis])).cast("double")


def surface(voxels: DataFrame, cfg: MapConfig, every: int = 1) -> DataFrame:
    """Occupied voxels of rank 0 or 1, as centres x, y, z; every: lattice sub-sampling inside each cell."""
    v = cells(voxels.where("rank <= 1 and occupied"), cfg)
    f = max(1, every)
    if f > 1:
        v = v.where(f"vx % {f} = 0 and vy % {f} = 0 and vz % {f} = 0")
    return v.select(*LATTICE, *[centre(cfg, i, n).alias(a) for i, (n, a) in enumerate(zip(VOXEL, "xyz", strict=True))])


def occupied_cells(voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    return cells(voxels.where("occupied"), cfg).select("cx", "cy", "cz").distinct()


def dense(voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    """All voxels of each cell with an occupied one; untouched voxels are rank 16, s 1, hits 0."""
    m = cfg.per_metre
    seq = F.sequence(F.lit(0), F.lit(m - 1))
    grid = occupied_cells(voxels, cfg)
    for a in "zyx":
        grid = grid.withColumn(f"v{a}", F.explode(seq))
    grid = grid.withColumns({f"i{a}": F.col(f"c{a}") * m + F.col(f"v{a}") for a in "xyz"})
    j = grid.join(voxels, VOXEL, "left")
    return j.select("cx", "cy", "cz", *[centre(cfg, i, n).alias(a) for i, (n, a) in enumerate(zip(VOXEL, "xyz", strict=True))], F.coalesce("rank", F.lit(16)).alias("d_manhattan"), F.when(F.col("occupied"), 0).otherwise(1).alias("s"), F.coalesce("hits", F.lit(0)).alias("hits"))


def occupied_centres(voxels: DataFrame, cfg: MapConfig) -> DataFrame:
    v = cells(voxels.where("occupied"), cfg)
    return v.select("cx", "cy", "cz", *[centre(cfg, i, n).alias(a) for i, (n, a) in enumerate(zip(VOXEL, "xyz", strict=True))])


def _ordered(points: DataFrame):
    rows = points.orderBy(*[c for c in LATTICE if c in points.columns]).select("x", "y", "z")
    return rows.toLocalIterator()  # a partition at a time


def _stream(points: DataFrame, path: str, head) -> int:
    """A header with the count, then float32 triples; an empty cloud writes no file."""
    n = points.count()
    if n:
        with open(path, "wb") as f:
            f.write(head(n).encode())
            for r in _ordered(points):
                f.write(struct.pack("<3f", *r))
    return n


def save_pcd(points: DataFrame, path: str) -> int:
    return _stream(points, path, lambda n: f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n")


def save_ply(points: DataFrame, path: str) -> int:
    return _stream(points, path, lambda n: f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n")


def save_cell_csv(voxels: DataFrame, cfg: MapConfig, folder: str) -> int:
    """One X_Y_Z.csv of all voxels and one X_Y_Z.ply of the occupied centres for each occupied cell; written by the tasks."""
    os.makedirs(folder, exist_ok=True)

    def write(pdf):
        import pandas as pd

        c = tuple(int(pdf[k].iloc[0]) for k in ("cx", "cy", "cz"))
        name = "_".join(str(v + o) for v, o in zip(c, cfg.origin, strict=True))
        pdf = pdf.sort_values(["z", "y", "x"])
        pdf[["x", "y", "z", "d_manhattan", "s", "hits"]].to_csv(f"{folder}/{name}.csv", index=False, float_format="%.6f")
        occ = pdf[pdf.s == 0]
        with open(f"{folder}/{name}.ply", "w") as f:
            f.write(f"ply\nformat ascii 1.0\nelement vertex {len(occ)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
            f.writelines(f"{r.x:.6f} {r.y:.6f} {r.z:.6f}\n" for r in occ.itertuples())
        return pd.DataFrame({"cell": [name]})

    return dense(voxels, cfg).groupBy("cx", "cy", "cz").applyInPandas(write, "cell string").count()
