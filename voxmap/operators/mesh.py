"""Signed-field sampling, smoothing and marching cubes per cell, and the mesh writers."""

from __future__ import annotations

import functools
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.operators.cells import CELL
from voxmap.operators.export import cells
from voxmap.operators.integrate import VOXEL

CORNERS = [(i & 1, i >> 1 & 1, i >> 2) for i in range(8)]
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if bin(a ^ b).count("1") == 1]


@functools.lru_cache
def cases() -> list[list[tuple[int, int, int]]]:
    """Triangles (by edge numbers) for each set of inside corners, from a rule: on each face every run of inside corners
    is cut off by one segment; the segments close to loops, each fanned to triangles."""
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    faces = []
    for axis in range(3):
        u, v = (1 << (axis + 1) % 3, 1 << (axis + 2) % 3)
        for side in (0, 1):
            ring = [side << axis, (side << axis) | u, (side << axis) | u | v, (side << axis) | v]
            faces.append(ring if side else ring[::-1])
    out = []
    for case in range(256):
        nxt = {}
        for ring in faces:
            inside = [case >> c & 1 for c in ring]
            for k in range(4):
                if inside[k] and not inside[k - 1]:
                    end = k
                    while inside[(end + 1) % 4] and end - k < 3:
                        end += 1
                    a = number[frozenset((ring[k - 1], ring[k]))]
                    b = number[frozenset((ring[end % 4], ring[(end + 1) % 4]))]
                    nxt[b] = a
        tris = []
        while nxt:
            start = next(iter(nxt))
            loop, at = [start], nxt.pop(start)
            while at != start:
                loop.append(at)
                at = nxt.pop(at)
            tris += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
        out.append(tris)
    return out


def meshed_cells(voxels: DataFrame, cfg: MapConfig, allocated: DataFrame | None = None) -> DataFrame:
    """The allocated cells that see an occupied sample: of their own, or in the first layer of an upper neighbour.

    Without `allocated`, all lower neighbours in the grid count as allocated: a map that evicts nothing allocates the
    cells around each point, and a stencil's radius is far below a cell.
    """
    v = cells(voxels.where("occupied"), cfg)
    for a in "xyz":
        v = v.withColumn(f"c{a}", F.explode(F.when((F.col(f"v{a}") == 0) & (F.col(f"c{a}") > 0), F.array(F.col(f"c{a}"), F.col(f"c{a}") - 1)).otherwise(F.array(f"c{a}"))))
    v = v.select(*CELL).distinct()
    return v if allocated is None else v.join(allocated.select(*CELL), CELL, "left_semi")


def field(voxels: DataFrame, cfg: MapConfig, allocated: DataFrame | None = None) -> DataFrame:
    """(cx, cy, cz, vx, vy, vz, sdf): (n+1)^3 samples of each cell, -0.1 res in occupied voxels and +0.1 res elsewhere.

    allocated: the resident cells of a map that evicts; only cells that see an occupied sample are given.
    """
    m = cfg.per_metre
    grid = meshed_cells(voxels, cfg, allocated)
    for a in "zyx":
        grid = grid.withColumn(f"v{a}", F.explode(F.sequence(F.lit(0), F.lit(m))))
    grid = grid.withColumns({f"i{a}": F.col(f"c{a}") * m + F.col(f"v{a}") for a in "xyz"})
    s = 0.1 * cfg.res
    return grid.join(voxels.select(*VOXEL, "occupied"), VOXEL, "left").select("cx", "cy", "cz", "vx", "vy", "vz", F.when(F.col("occupied"), -s).otherwise(s).cast("float").alias("sdf"))


def smooth(v: np.ndarray) -> np.ndarray:
    """Separable Gaussian of sigma 1 and radius 1, renormalised at the borders."""
    w = np.exp(-0.5)
    for axis in range(3):
        pad = [(1, 1) if i == axis else (0, 0) for i in range(3)]
        p, one = np.pad(v, pad), np.pad(np.ones_like(v), pad)
        cut = lambda x, k, axis=axis: np.take(x, range(k, k + v.shape[axis]), axis)
        v = (cut(p, 1) + w * (cut(p, 0) + cut(p, 2))) / (cut(one, 1) + w * (cut(one, 0) + cut(one, 2)))
    return v


def march(v: np.ndarray, iso: float = 0.0) -> np.ndarray:
    """(triangles, 3, 3) vertex places in voxel units for v[x, y, z]."""
    n = [k - 1 for k in v.shape]
    idx = np.zeros(n, np.int64)
    for i, (x, y, z) in enumerate(CORNERS):
        idx |= (v[x : x + n[0], y : y + n[1], z : z + n[2]] < iso).astype(np.int64) << i
    at = np.argwhere((idx > 0) & (idx < 255))
    case, corner, edge, table = idx[tuple(at.T)], np.array(CORNERS), np.array(EDGES), cases()
    out, cube = [np.zeros((0, 3, 3))], [np.zeros(0, np.int64)]
    # all cubes of one case at once
    for k in np.unique(case):
        own, ends = np.flatnonzero(case == k), corner[edge[np.array(table[k])]]
        a, b = (at[own, None, None] + ends[:, :, i] for i in (0, 1))
        va, vb = v[tuple(np.moveaxis(a, -1, 0))], v[tuple(np.moveaxis(b, -1, 0))]
        out.append((a + (b - a) * ((iso - va) / (vb - va))[..., None]).reshape(-1, 3, 3))
        cube.append(np.repeat(own, len(table[k])))
    return np.concatenate(out)[np.argsort(np.concatenate(cube), kind="stable")]


def triangles(voxels: DataFrame, cfg: MapConfig, iso: float = 0.0, smoothing: bool = True, allocated: DataFrame | None = None) -> DataFrame:
    """(cx, cy, cz, tri, ax .. cz_) triangles of each cell; a group is one cell, so (n+1)^3 samples at most."""
    m, origin, names = cfg.per_metre, np.array(cfg.origin, float), [f"{p}{a}" for p in ("p", "q", "r") for a in "xyz"]

    def run(pdf):
        import pandas as pd

        v = np.zeros((m + 1, m + 1, m + 1))
        v[pdf.vx, pdf.vy, pdf.vz] = pdf.sdf
        c = np.array([pdf[k].iloc[0] for k in ("cx", "cy", "cz")])
        t = march(smooth(v) if smoothing and (v < 0).any() else v, iso) / m + c + origin
        d = pd.DataFrame(t.reshape(-1, 9), columns=names)
        d.insert(0, "tri", range(len(d)))
        for k, x in zip(("cz", "cy", "cx"), c[::-1], strict=True):
            d.insert(0, k, x)
        return d

    ddl = "cx int, cy int, cz int, tri int, " + ", ".join(f"{n} double" for n in names)
    return field(voxels, cfg, allocated).groupBy("cx", "cy", "cz").applyInPandas(run, ddl)


def save_mesh(tris: DataFrame, path: str) -> int:
    """Binary STL or XML VTP by the extension, which is checked before anything is computed."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("stl", "vtp"):
        raise ValueError("a mesh is saved as .stl or .vtp")
    cols = [f"{p}{a}" for p in ("p", "q", "r") for a in "xyz"]
    t = tris.orderBy("cz", "cy", "cx", "tri").select(*cols)
    n = t.count()
    if kind == "stl":
        with open(path, "wb") as f:
            f.write(b"voxel map".ljust(80) + struct.pack("<I", n))
            for r in t.toLocalIterator():
                p = np.array(r, float).reshape(3, 3)
                k = np.cross(p[1] - p[0], p[2] - p[0])
                f.write(struct.pack("<12fH", *(k / (np.linalg.norm(k) or 1)), *p.ravel(), 0))
    else:
        with open(path, "w") as f:
            f.write(f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian"><PolyData><Piece NumberOfPoints="{3 * n}" NumberOfPolys="{n}"><Points><DataArray type="Float32" NumberOfComponents="3" format="ascii">\n')
            f.writelines(" ".join(f"{x:.6f}" for x in r) + "\n" for r in t.toLocalIterator())
            f.write('</DataArray></Points><Polys><DataArray type="Int64" Name="connectivity" format="ascii">\n')
            f.writelines(f"{3 * i} {3 * i + 1} {3 * i + 2}\n" for i in range(n))
            f.write('</DataArray><DataArray type="Int64" Name="offsets" format="ascii">\n')
            f.writelines(f"{3 * i + 3}\n" for i in range(n))
            f.write("</DataArray></Polys></Piece></PolyData></VTKFile>\n")
    return n
