"""One object for a map's life: scans and poses in, voxels, queries and the four exports out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from voxmap.config import MapConfig
from voxmap.operators import export, mesh, query
from voxmap.plans import associate, build_map


class VoxelMap:
    """points(frame_id, point_idx, px, py, pz), scans(frame_id, stamp_us) and poses as DataFrames; lazy until an export.

    Exports have fixed names in `folder` (the current one unless given) and return the path.
    """

    def __init__(self, cfg: MapConfig, folder: str = "."):
        self.cfg, self.folder, self.voxels = cfg, folder, None

    def load(self, points: DataFrame, scans: DataFrame, poses: DataFrame | None = None, tree: bool = False) -> VoxelMap:
        self.points, self.posed = points, associate(scans, poses, self.cfg, tree)
        return self

    def integrate(self, evict: bool = False) -> VoxelMap:
        self.voxels = build_map(self.points, self.posed, self.cfg, evict)
        return self

    def lookup(self, probes: DataFrame) -> DataFrame:
        return query.lookup(probes, self.voxels, self.cfg)

    def distance(self, probes: DataFrame) -> DataFrame:
        return query.trilinear(probes, self.voxels, self.cfg)

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def save_pcd(self) -> str:
        export.save_pcd(export.surface(self.voxels, self.cfg), self._path("grid_data.pcd"))
        return self._path("grid_data.pcd")

    def save_ply(self) -> str:
        export.save_ply(export.surface(self.voxels, self.cfg), self._path("grid_data.ply"))
        return self._path("grid_data.ply")

    def save_csv(self) -> str:
        export.save_cell_csv(self.voxels, self.cfg, self._path("grid_data_csv"))
        return self._path("grid_data_csv")

    def save_mesh(self, iso: float = 0.0) -> str:
        mesh.save_mesh(mesh.triangles(self.voxels, self.cfg, iso), self._path("mesh.stl"))
        return self._path("mesh.stl")
