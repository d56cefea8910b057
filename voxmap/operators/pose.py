"""Pose association: nearest within a tolerance, interpolated frame-tree lookup, history, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.functions import apply_rotation, f32, rotation, rpy_rotation, yaw_rotation

POSE = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]


def last_poses(poses: DataFrame, n: int = 100) -> DataFrame:
    """The n newest arrivals: a top-k, so no global sort of the history."""
    return poses.orderBy(F.desc("pose_seq")).limit(n)


def nearest_pose(scans: DataFrame, poses: DataFrame, tolerance_us: int = 100_000) -> DataFrame:
    """Each scan with the pose nearest in time; ties keep the earliest arrival, scans beyond the tolerance go.

    Both sides are cut in time buckets as long as the tolerance and joined on the bucket and its two neighbours: an
    equi-join, whatever the length of the history. Pre-aggregation of ties keeps one candidate per scan.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(tolerance_us))
    s = scans.withColumn("_b", F.explode(F.array(*[b("stamp_us") + k for k in (-1, 0, 1)])))
    p = poses.select(F.col("stamp_us").alias("_pt"), F.col("pose_seq"), *[c for c in POSE if c in poses.columns]).withColumn("_b", b("_pt"))
    j = s.join(p, "_b").withColumn("_dt", F.abs(F.col("stamp_us") - F.col("_pt"))).where(F.col("_dt") <= tolerance_us)
    rest = [c for c in poses.columns if c in POSE]
    best = F.min(F.struct(F.col("_dt"), F.col("pose_seq"), *rest)).alias("_m")
    return j.groupBy(*scans.columns).agg(best).select(*scans.columns, F.col("_m.pose_seq").alias("pose_seq"), F.col("_m._dt").alias("dt_us"), *[F.col(f"_m.{c}").alias(c) for c in rest])


def lookup_pose(scans: DataFrame, poses: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """The pose of each scan's (parent, child) link at its time: linear and spherical interpolation, no extrapolation;
    stamp 0 is the latest pose.

    The last pose at or before and the first at or after come from windows within time buckets, so the poses of one
    link are spread over as many tasks as there are buckets. Only a row per bucket goes through a window over a whole
    link: the last pose of the buckets before and the first one of those after.
    """
    link = ["parent", "child"]
    p = poses.select(*link, F.col("stamp_us").alias("_t"), F.struct(F.col("stamp_us").alias("t"), "pose_seq", *POSE).alias("_p"), F.lit(None).cast("long").alias("frame_id"))
    live = scans.where("stamp_us <> 0").select(*link, F.col("stamp_us").alias("_t"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), "frame_id")
    both = p.unionByName(live).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    ends = both.groupBy(*link, "_b").agg(F.max("_p").alias("_hi"), F.min("_p").alias("_lo"))
    past = Window.partitionBy(*link).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*link).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*link, "_b", F.last("_hi", True).over(past).alias("_before"), F.last("_lo", True).over(future).alias("_after"))
    w = Window.partitionBy(*link, "_b").orderBy("_t", F.col("_p").isNull(), "_p.pose_seq")
    fw = Window.partitionBy(*link, "_b").orderBy(F.desc("_t"), F.col("_p").isNull(), F.desc("_p.pose_seq"))
    u = both.withColumn("a", F.last("_p", True).over(w)).withColumn("z", F.last("_p", True).over(fw)).where("frame_id is not null").join(ends, [*link, "_b"])
    u = u.withColumns({"a": F.coalesce("a", "_before"), "z": F.coalesce("z", "_after")}).where("a is not null and z is not null")
    f = F.when(F.col("z.t") == F.col("a.t"), F.lit(0.0)).otherwise((F.col("_t") - F.col("a.t")) / (F.col("z.t") - F.col("a.t")))
    dot = sum((F.col(f"a.{c}") * F.col(f"z.{c}") for c in POSE[3:]), F.lit(0.0))
    sign, angle = F.when(dot < 0, -1.0).otherwise(1.0), F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.sin(angle) < 1e-9
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / F.when(near, 1.0).otherwise(F.sin(angle)))
    wz = F.when(near, f).otherwise(F.sin(f * angle) / F.when(near, 1.0).otherwise(F.sin(angle)))
    mixed = u.select("frame_id", *link, *[(F.col(f"a.{c}") * (1 - f) + F.col(f"z.{c}") * f).alias(c) for c in POSE[:3]], *[(F.col(f"a.{c}") * wa + sign * F.col(f"z.{c}") * wz).alias(c) for c in POSE[3:]])
    latest = poses.groupBy(*link).agg(F.max(F.struct("stamp_us", "pose_seq", *POSE)).alias("_m"))
    zero = scans.where("stamp_us = 0").join(latest, link).select("frame_id", *link, *[F.col(f"_m.{c}").cast("double").alias(c) for c in POSE])
    return mixed.unionByName(zero)


def frame_path(poses: DataFrame, root: str, leaf: str) -> list[str]:
    """The frames from root down to leaf; a frame has one parent. The driver takes the links, a row per frame."""
    up = {r.child: r.parent for r in poses.select("parent", "child").distinct().collect()}
    path = [leaf]
    while path[-1] != root:
        if path[-1] not in up or len(path) > len(up):
            raise ValueError(f"no chain of links from {root!r} to {leaf!r}")
        path.append(up[path[-1]])
    return path[::-1]


def lookup_chain(scans: DataFrame, poses: DataFrame, frames: list[str]) -> DataFrame:
    """(frame_id, pose) of the last of `frames` in the first one: the lookups of all links between, composed.

    A scan that lacks a pose on any link goes, as in a lookup of one link.
    """
    out = None
    for parent, child in zip(frames, frames[1:]):
        link = {"parent": F.lit(parent), "child": F.lit(child)}
        one = lookup_pose(scans.withColumns(link), poses.where((F.col("parent") == parent) & (F.col("child") == child))).select("frame_id", *POSE)
        out = one if out is None else compose(out, one.select("frame_id", *[F.col(c).alias(f"_{c}") for c in POSE]))
    if out is None:
        raise ValueError("a chain has two frames or more")
    return out


def compose(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer(frame_id, tx .. qz) after inner(frame_id, _tx .. _qz): rotations multiply, the inner translation is turned."""
    c = {n: F.col(n).cast("double") for n in (*POSE, *[f"_{n}" for n in POSE])}
    w, x, y, z = (c[n] for n in POSE[3:])
    a, i, j, k = (c[f"_{n}"] for n in POSE[3:])
    t = [c[f"_{n}"] for n in POSE[:3]]
    # t + 2 w (q x t) + 2 q x (q x t)
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    first = cross([x, y, z], t)
    second = cross([x, y, z], first)
    moved = [c[n] + t[m] + 2 * w * first[m] + 2 * second[m] for m, n in enumerate(POSE[:3])]
    turned = [w * a - x * i - y * j - z * k, w * i + x * a + y * k - z * j, w * j - x * k + y * a + z * i, w * k + x * j - y * i + z * a]
    return outer.join(inner, "frame_id").select("frame_id", *[e.alias(n) for e, n in zip([*moved, *turned], POSE, strict=True)])


def identity_pose(scans: DataFrame) -> DataFrame:
    return scans.select("*", *[f32(1.0 if c == "qw" else 0.0).alias(c) for c in POSE])


def to_world(points: DataFrame, matrix: list | None = None, translation: tuple | None = None) -> DataFrame:
    """px, py, pz in the world frame as wx, wy, wz; the sensor stands at sx, sy, sz.

    Without a matrix the pose columns (tx .. qz) of the rows are used.
    """
    t = [f32(v) for v in translation] if translation is not None else [f32(F.col(c)) for c in POSE[:3]]
    x, y, z = (f32(F.col(c)) for c in ("px", "py", "pz"))
    w = apply_rotation(matrix or rotation(), x, y, z, t)
    return points.select("*", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"), strict=True)], *[c.alias(n) for c, n in zip(t, ("sx", "sy", "sz"), strict=True)])


def to_world_yaw(points: DataFrame, tx: float, ty: float, tz: float, yaw: float) -> DataFrame:
    return to_world(points, yaw_rotation(yaw), (tx, ty, tz))


def to_world_rpy(points: DataFrame, tx: float, ty: float, tz: float, roll: float, pitch: float, yaw: float) -> DataFrame:
    return to_world(points, rpy_rotation(roll, pitch, yaw), (tx, ty, tz))
