"""Whole plans: scans and poses to a map, and the map's read-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.operators import cells, filters, integrate, pose


def associate(scan_times: DataFrame, poses: DataFrame | None, cfg: MapConfig, tree: bool = False) -> DataFrame:
    """One row per accepted scan with its pose."""
    if not cfg.use_tf or poses is None:
        return pose.identity_pose(scan_times)
    return pose.lookup_pose(scan_times, poses) if tree else pose.nearest_pose(scan_times, poses, cfg.tolerance_us)


def world_points(points: DataFrame, posed: DataFrame, cfg: MapConfig) -> DataFrame:
    """Filtered, down-sampled points in the world frame; filters run in the sensor frame, before the join."""
    p = filters.every_nth(filters.range_filter(points, cfg.min_range, cfg.max_range), cfg.every)
    return pose.to_world(p.join(posed.select("frame_id", *pose.POSE), "frame_id"))


def build_map(points: DataFrame, posed: DataFrame, cfg: MapConfig, evict: bool = False) -> DataFrame:
    w = world_points(points, posed, cfg)
    if not evict:
        return integrate.integrate(w, cfg)
    return integrate.integrate_resident(w, cfg, cells.residency(w, cfg))


def counters(scan_times: DataFrame, posed: DataFrame, kept: DataFrame) -> DataFrame:
    """frames_in, frames_dropped, points_kept: the frame counter also counts dropped scans."""
    a = scan_times.agg(F.countDistinct("frame_id").alias("frames_in"))
    b = posed.agg(F.countDistinct("frame_id").alias("ok"))
    c = kept.agg(F.count(F.lit(1)).alias("points_kept"))
    # one row each
    return a.crossJoin(b).crossJoin(c).select("frames_in", (F.col("frames_in") - F.col("ok")).alias("frames_dropped"), "points_kept")


def published_cloud(points: DataFrame, posed: DataFrame, cfg: MapConfig, frame: str = "odom") -> DataFrame:
    """The filtered, thinned points of each accepted scan in the world frame, under the scan's own stamp."""
    stamped = posed.select("frame_id", "stamp_us", F.lit(frame).alias("frame"))
    return world_points(points, posed, cfg).join(stamped, "frame_id").select("frame_id", "stamp_us", "frame", "point_idx", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
