"""Registered queries of the volumetric engine and their SQL equivalents, over point and pose tables made from the
driver's tables (a scan's points from lineitem, scans from supplier and events, poses from events, probes from part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.functions import direction_bin, f32
from voxmap.operators import cells as C
from voxmap.operators import export as E
from voxmap.operators import filters as FI
from voxmap.operators import integrate as I  # noqa: E741
from voxmap.operators import kernel as K
from voxmap.operators import mesh as M
from voxmap.operators import pose as P
from voxmap.operators import query as Q
from voxmap.plans import counters, published_cloud

CFG = MapConfig((-16.0,) * 3, (16.0,) * 3, 0.1, 10_000, 1.0, 5.0, 2, 3, 40, 40, 5, "L2", 5)

POINTS = """select l_suppkey as frame_id,
  row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as point_idx,
  cast(cast((l_partkey * 7) % 161 - 80 as double) / 20 + 0.0125 as float) as px,
  cast(cast((l_orderkey * 3) % 161 - 80 as double) / 20 + 0.0125 as float) as py,
  cast(cast((l_linenumber * 5) % 41 - 20 as double) / 20 + 0.0125 as float) as pz
from lineitem"""
SCANS = """select s_suppkey as frame_id, {us} + ((s_suppkey * 53) % 16 - 8) * 20000 as stamp_us
from supplier join (select *, count(*) over () as n_ev from events) ev on event_id = (s_suppkey * 37) % n_ev"""
#: the same rows with the number of events taken first, so that Spark joins on equal keys in place of comparing all pairs
SCANS_EQUI = """select s_suppkey as frame_id, {us} + ((s_suppkey * 53) % 16 - 8) * 20000 as stamp_us
from (select s_suppkey, (s_suppkey * 37) % n_ev as picked from supplier cross join (select count(*) as n_ev from events) n) s
join (select * from events) ev on event_id = picked"""
POSES = """select row_number() over (order by t, k, event_id) as pose_seq, t as stamp_us,
  cast(cast(user_id % 21 - 10 as double) / 10 as float) as tx, cast(cast(event_id % 17 - 8 as double) / 10 as float) as ty, cast(0 as float) as tz,
  cast(case event_type when 'view' then 1 when 'click' then 0.8 when 'purchase' then 0.6 when 'signup' then 0.96 else 0.28 end as float) as qw,
  cast(0 as float) as qx, cast(0 as float) as qy,
  cast(case event_type when 'view' then 0 when 'click' then 0.6 when 'purchase' then 0.8 when 'signup' then 0.28 else 0.96 end as float) as qz
from (select {us} + k * 40000 as t, k, event_id, user_id, event_type from events cross join (select 0 as k union all select 1 as k) kk) e"""
PROBES = """select p_partkey as probe_id, cast((p_partkey * 13) % 161 - 80 as double) / 20 + 0.0175 as x,
  cast((p_partkey * 29) % 161 - 80 as double) / 20 + 0.0175 as y, cast((p_partkey * 5) % 41 - 20 as double) / 20 + 0.0175 as z from part"""
_US = {"spark": "unix_micros(cast(ts as timestamp))", "duck": "epoch_us(ts)"}


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture's text on tables read from sf_dir; TIMESTAMP_NTZ values are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "events", "part") if f" {t}" in text}
    for t in tables:
        text = text.replace(f"from {t} ", f"from {{{t}}} ").replace(f"from {t})", f"from {{{t}}})").replace(f"from {t}\n", f"from {{{t}}}\n")
        if text.endswith(f"from {t}"):
            text = text[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **tables)


def points(spark, d):
    return _sql(spark, d, POINTS).withColumn("point_idx", F.col("point_idx").cast("long"))


def scan_times(spark, d):
    return _sql(spark, d, SCANS_EQUI.format(us=_US["spark"]))


def poses(spark, d):
    return _sql(spark, d, POSES.format(us=_US["spark"]))


def probes(spark, d):
    return _sql(spark, d, PROBES)


def kept(spark, d):
    return FI.every_nth(FI.range_filter(points(spark, d), CFG.min_range, CFG.max_range), CFG.every)


def world(spark, d):
    m = [[f32(0.6), f32(-0.8), f32(0.0)], [f32(0.8), f32(0.6), f32(0.0)], [f32(0.0), f32(0.0), f32(1.0)]]
    return P.to_world(kept(spark, d), m, ((F.col("frame_id") % 5).cast("double") / 10, 0.0, 0.0))


def voxels(spark, d):
    return I.integrate(world(spark, d), CFG)


def _xyz(df, *cols):
    return df.select(*cols, *[F.round(F.col(a).cast("double"), 6).alias(a) for a in "xyz"])


def q_range(spark, d):
    return FI.range_filter(points(spark, d), CFG.min_range, CFG.max_range).select("frame_id", "point_idx")


def q_every(spark, d):
    return kept(spark, d).select("frame_id", "point_idx")


def q_nearest(spark, d):
    return P.nearest_pose(scan_times(spark, d), poses(spark, d), CFG.tolerance_us).select("frame_id", "stamp_us", "pose_seq", "dt_us")


def q_lookup(spark, d):
    link = {"parent": F.lit("odom"), "child": F.lit("lidar")}
    out = P.lookup_pose(scan_times(spark, d).withColumns(link), poses(spark, d).withColumns(link))
    return out.select("frame_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("tx", "ty", "qw", "qz")])


def q_last(spark, d):
    return P.last_poses(poses(spark, d), 100).select("pose_seq", "stamp_us")


def q_world_pose(spark, d):
    posed = P.nearest_pose(scan_times(spark, d), poses(spark, d), CFG.tolerance_us)
    w = P.to_world(kept(spark, d).join(posed.select("frame_id", *P.POSE), "frame_id"))
    return w.select("frame_id", "point_idx", *[F.round(F.col(f"w{a}").cast("double"), 3).alias(a) for a in "xyz"])


def q_crop(spark, d):
    return FI.crop_xy(world(spark, d), 2.5).select("frame_id", "point_idx")


def q_bins(spark, d):
    return world(spark, d).groupBy(direction_bin(*[F.col(f"w{a}") - F.col(f"s{a}") for a in "xyz"], 40, 40).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def q_stencil_l2(spark, d):
    return K.stencil(spark, CFG)


def q_stencil_l1(spark, d):
    return K.stencil(spark, MapConfig(kernel_size=11, distance_mode="L1"))


def q_kernel(spark, d):
    return K.kernel(spark, CFG).groupBy("bin").agg(F.sum("occ").alias("occupied"), F.sum("rank").alias("ranks"))


def q_cells(spark, d):
    return C.touched_cells(world(spark, d), CFG)


def q_residency(spark, d):
    """A small ring, so that cells are evicted and come back."""
    small = MapConfig(CFG.low, CFG.high, 0.1, 200, 1.0, 5.0, 2, 3, 40, 40, 5, "L2", 5)
    return C.residency(world(spark, d), small)


def q_voxels(spark, d):
    return I.with_mask(voxels(spark, d))


def q_resident_map(spark, d):
    w = world(spark, d)
    return I.integrate_resident(w, CFG, C.residency(w, CFG))


def q_merge(spark, d):
    w = world(spark, d)
    return I.merge(I.integrate(w.where("frame_id % 2 = 0"), CFG), I.integrate(w.where("frame_id % 2 = 1"), CFG), CFG)


def q_surface(spark, d):
    return _xyz(E.surface(voxels(spark, d), CFG))


def q_surface_sub(spark, d):
    return _xyz(E.surface(voxels(spark, d), CFG, 2))


def q_dense(spark, d):
    return _xyz(E.dense(voxels(spark, d), CFG), "cx", "cy", "cz", "d_manhattan", "s", "hits")


def q_centres(spark, d):
    return _xyz(E.occupied_centres(voxels(spark, d), CFG), "cx", "cy", "cz")


def q_lookup_voxel(spark, d):
    return Q.lookup(probes(spark, d), voxels(spark, d), CFG)


def q_walk(spark, d):
    return Q.walk(probes(spark, d), voxels(spark, d), CFG, 8)


def q_trilinear(spark, d):
    t = Q.trilinear(probes(spark, d), voxels(spark, d), CFG)
    return t.select("probe_id", *[f"a{i}" for i in range(8)], F.round("value", 4).alias("value"))


def q_field(spark, d):
    w = world(spark, d)
    return M.field(I.integrate(w, CFG), CFG, C.touched_cells(w, CFG)).groupBy("cx", "cy", "cz").agg(F.sum(F.when(F.col("sdf") < 0, 1).otherwise(0)).alias("inside"), F.count(F.lit(1)).alias("samples"))


def q_mesh(spark, d):
    w = world(spark, d)
    return M.triangles(I.integrate(w, CFG), CFG, allocated=C.touched_cells(w, CFG))


def q_counters(spark, d):
    s = scan_times(spark, d)
    posed = P.nearest_pose(s, poses(spark, d), CFG.tolerance_us)
    return counters(s, posed, kept(spark, d).join(posed.select("frame_id"), "frame_id"))


def wide(spark, d):
    """Points up to 20 m from the origin, so that some are outside the grid."""
    return points(spark, d).select("frame_id", "point_idx", *[(F.col(f"p{a}") * f32(5.0)).alias(f"w{a}") for a in "xyz"])


def q_in_grid(spark, d):
    return wide(spark, d).where(FI.in_grid(CFG, *[F.col(f"w{a}") for a in "xyz"])).select("frame_id", "point_idx")


def q_kernel_fits(spark, d):
    return wide(spark, d).where(FI.kernel_fits(CFG)).select("frame_id", "point_idx")


def _moved(w):
    return w.select("frame_id", "point_idx", *[F.round(F.col(f"w{a}").cast("double"), 3).alias(a) for a in "xyz"])


def q_yaw(spark, d):
    return _moved(P.to_world_yaw(kept(spark, d), 1.5, -0.5, 0.25, 0.7))


def q_rpy(spark, d):
    return _moved(P.to_world_rpy(kept(spark, d), 1.5, -0.5, 0.25, 0.1, -0.2, 0.3))


def q_zero_stamp(spark, d):
    """Three links, so that a scan must take the latest pose of its own."""
    child = lambda c: {"parent": F.lit("odom"), "child": F.concat(F.lit("lidar"), (F.col(c) % 3).cast("string"))}
    out = P.lookup_pose(scan_times(spark, d).withColumn("stamp_us", F.lit(0).cast("long")).withColumns(child("frame_id")), poses(spark, d).withColumns(child("pose_seq")))
    return out.select("frame_id", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "qw", "qz")])


def q_chain(spark, d):
    """odom - base - lidar: the latest poses of two links, composed."""
    even = F.col("pose_seq") % 2 == 0
    p = poses(spark, d).withColumns({"parent": F.when(even, "odom").otherwise("base"), "child": F.when(even, "base").otherwise("lidar")})
    out = P.lookup_chain(scan_times(spark, d).withColumn("stamp_us", F.lit(0).cast("long")), p, ["odom", "base", "lidar"])
    return out.select("frame_id", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "qw", "qz")])


def q_no_evict(spark, d):
    return C.residency(world(spark, d), CFG).select(*C.CELL, "alloc_frame")


def q_rank_table(spark, d):
    """11 voxels an edge: more distances than ranks."""
    return K.rank_table(spark, MapConfig(kernel_size=11, distance_mode="L2"))


def q_preview(spark, d):
    """A shadow radius that ends before the stencil's corners."""
    return K.preview(spark, MapConfig(kernel_size=7, distance_mode="L2", shadow_radius=3), 805).select("ox", "oy", "rank", "occ", "sign")


def q_published(spark, d):
    posed = P.nearest_pose(scan_times(spark, d), poses(spark, d), CFG.tolerance_us)
    cloud = published_cloud(points(spark, d), posed, CFG)
    return cloud.select("frame_id", "stamp_us", "frame", "point_idx", *[F.round(F.col(a).cast("double"), 3).alias(a) for a in "xyz"])


QUERIES = {
    "range_filter": q_range, "every_nth": q_every, "nearest_pose": q_nearest, "lookup_pose": q_lookup, "last_poses": q_last, "world_points": q_world_pose, "crop_xy": q_crop,
    "direction_bins": q_bins, "stencil_l2": q_stencil_l2, "stencil_l1": q_stencil_l1, "kernel": q_kernel, "touched_cells": q_cells, "residency": q_residency, "voxel_map": q_voxels,
    "resident_map": q_resident_map, "map_merge": q_merge, "surface_cloud": q_surface, "surface_every_second": q_surface_sub, "dense_cells": q_dense, "occupied_centres": q_centres,
    "voxel_lookup": q_lookup_voxel, "voxel_walk": q_walk, "trilinear": q_trilinear, "signed_field": q_field, "mesh": q_mesh, "scan_counters": q_counters,
    "in_grid": q_in_grid, "kernel_fits": q_kernel_fits, "transform_yaw": q_yaw, "transform_rpy": q_rpy, "pose_latest_zero_stamp": q_zero_stamp, "pose_chain": q_chain,
    "cell_residency_no_evict": q_no_evict, "rank_table": q_rank_table, "kernel_preview": q_preview, "published_cloud": q_published,
}

# ---- SQL equivalents -------------------------------------------------------------------------------------------------
_PI = "3.141592653589793"
_F = "cast({} as float)".format
_BIN = f"""case when dx = 0 and dy = 0 and dz = 0 then 0 else
  greatest(0, least(39, cast(floor((asin(greatest(-1.0, least(1.0, dz / sqrt(dx*dx + dy*dy + dz*dz)))) + {_PI} / 2) * (40 / {_PI})) as int))) * 40
  + greatest(0, least(39, cast(floor((atan2(dy, dx) + case when atan2(dy, dx) < 0 then 2 * {_PI} else 0 end) * (40 / (2 * {_PI}))) as int))) end"""


def _stencil(r: int, rank: str) -> str:
    rng = f"(select unnest(range(-{r}, {r + 1})) {{0}}) t{{0}}"
    grid = f"select cast(row_number() over (order by oz, oy, ox) - 1 as int) k, cast(ox as int) ox, cast(oy as int) oy, cast(oz as int) oz, cast(ox*ox+oy*oy+oz*oz as int) r2 from {rng.format('oz')} cross join {rng.format('oy')} cross join {rng.format('ox')}"
    return f"select *, cast((1 << rank) - 1 as int) mask from (select *, cast(least(16, {rank}) as int) rank from ({grid}))"


_L2, _L1 = _stencil(2, "dense_rank() over (order by r2) - 1"), _stencil(5, "abs(ox) + abs(oy) + abs(oz)")
_DIRS = f"""select e * 40 + a bin, cast(cos(-{_PI}/2 + (e + 0.5) * {_PI}/40) * cos((a + 0.5) * 2 * {_PI}/40) as float) dx, cast(cos(-{_PI}/2 + (e + 0.5) * {_PI}/40) * sin((a + 0.5) * 2 * {_PI}/40) as float) dy,
  cast(sin(-{_PI}/2 + (e + 0.5) * {_PI}/40) as float) dz from (select unnest(range(40)) e) cross join (select unnest(range(40)) a)"""
_OCC = "case when r2 = 0 or (dx * ox + dy * oy + dz * oz >= 0 and r2 <= 25) then 1 else 0 end"
_CTE = f"""with points as ({POINTS}), near as (select * from points where cast(px*px + py*py + pz*pz as double) between 1 and 25),
kept as (select frame_id, point_idx, px, py, pz from (select *, row_number() over (partition by frame_id order by point_idx) - 1 r from near) where r % 2 = 0),
world as (select frame_id, point_idx, sx, {_F(0.6)} * px - {_F(0.8)} * py + sx wx, {_F(0.8)} * px + {_F(0.6)} * py wy, pz wz
  from (select *, cast(cast(frame_id % 5 as double) / 10 as float) sx from kept)),
scans as ({SCANS.format(us=_US["duck"])}), poses as ({POSES.format(us=_US["duck"])}), probes as ({PROBES}),
stencil as ({_L2}), dirs as ({_DIRS}),
based as (select *, {_BIN} bin from (select cast(wx - sx as double) dx, cast(wy as double) dy, cast(wz as double) dz,
  {", ".join(f"cast(floor((w{a} - {_F(-16)} - {_F(0.2)}) * {_F(10)}) as int) q{a}" for a in "xyz")} from world)),
voxels as (select ix, iy, iz, cast(min(rank) as int) rank, cast(least(3, sum(n * occ)) as int) hits, sum(n * occ) >= 3 occupied from
  (select qx + ox + 2 ix, qy + oy + 2 iy, qz + oz + 2 iz, rank, n, {_OCC.replace("dx", "d.dx").replace("dy", "d.dy").replace("dz", "d.dz")} occ
   from (select bin, qx, qy, qz, count(*) n from based group by all) g join dirs d using (bin) cross join stencil) group by all),
placed as (select *, {", ".join(f"cast(i{a} // 10 as int) c{a}" for a in "xyz")}, {", ".join(f"i{a} % 10 v{a}" for a in "xyz")}, {", ".join(f"round((i{a} + 0.5::double) / 10 - 16, 6) {a}" for a in "xyz")} from voxels)
"""
_ASOF = """select frame_id, stamp_us, pose_seq, dt_us, tx, ty, tz, qw, qx, qy, qz from (select s.frame_id, s.stamp_us, p.* exclude (stamp_us), abs(s.stamp_us - p.stamp_us) dt_us,
  row_number() over (partition by s.frame_id order by abs(s.stamp_us - p.stamp_us), p.pose_seq) r from scans s join poses p on p.stamp_us between s.stamp_us - 100000 and s.stamp_us + 100000) where r = 1"""
_READ = "coalesce(v.rank, 16) rank, coalesce(v.hits, 255) hits, coalesce(v.occupied, false) occupied"
_AT = ", ".join(f"cast(floor((cast({a} as float) - {_F(-16)}) * {_F(10)}) as int) i{a}" for a in "xyz")
_FULL = "(select unnest(range({0})) vx) cross join (select unnest(range({0})) vy) cross join (select unnest(range({0})) vz)"
_SLERP = """select frame_id, {0} from (select *, case when sin(ang) < 1e-9 then 1 - f else sin((1 - f) * ang) / sin(ang) end wa, case when sin(ang) < 1e-9 then f else sin(f * ang) / sin(ang) end wz
  from (select *, case when zt = ta then 0.0::double else (t - ta)::double / (zt - ta) end f, case when dot < 0 then -1.0 else 1.0 end sg, acos(least(1.0, abs(dot))) ang
  from (select a.frame_id, a.t, a.stamp_us ta, z.stamp_us zt, {1}, a.qw::double * z.qw + a.qz::double * z.qz dot
    from (select s.frame_id, s.stamp_us t, p.*, row_number() over (partition by s.frame_id order by p.stamp_us desc, p.pose_seq desc) rn from scans s join poses p on p.stamp_us <= s.stamp_us) a
    join (select s.frame_id, p.*, row_number() over (partition by s.frame_id order by p.stamp_us, p.pose_seq) rn from scans s join poses p on p.stamp_us >= s.stamp_us) z on a.frame_id = z.frame_id and a.rn = 1 and z.rn = 1)))""".format(
    ", ".join([f"round(a{c} * (1 - f) + z{c} * f, 6) {c}" for c in ("tx", "ty")] + [f"round(a{c} * wa + sg * z{c} * wz, 6) {c}" for c in ("qw", "qz")]),
    ", ".join(f"{p}.{c}::double {p}{c}" for c in ("tx", "ty", "qw", "qz") for p in "az"),
)
_CORNER = ", ".join(f"max(case when c = {i} then rank end)::double c{i}" for i in range(8))
_COEF = ["c0", "c1-c0", "c2-c0", "c4-c0", "c3-c1-c2+c0", "c5-c1-c4+c0", "c6-c2-c4+c0", "c7-c3-c5-c6+c1+c2+c4-c0"]
_TERM = ["1", "ux", "uy", "uz", "ux*uy", "ux*uz", "uy*uz", "ux*uy*uz"]

_TOUCHED = "select distinct frame_id, " + ", ".join(f"cast(floor(w{a} + k{a} + 16) as int) c{a}" for a in "xyz") + " from world cross join " + " cross join ".join(f"(select unnest([-1, 0, 1]) k{a})" for a in "xyz") + " where " + " and ".join(f"w{a} + k{a} > -15 and w{a} + k{a} < 15" for a in "xyz")

_WIDE = _CTE + ", wide as (select frame_id, point_idx, " + ", ".join(f"p{a} * {_F(5)} w{a}" for a in "xyz") + " from points) select frame_id, point_idx from wide where "
_D = lambda e: f"cast({e} as float)"
_ROLL, _PITCH, _YAW = "0.1::double", "-0.2::double", "0.3::double"


def _turned(m: list[list[str]]) -> str:
    t = (1.5, -0.5, 0.25)
    return _CTE + "select frame_id, point_idx, " + ", ".join(f"round(({_D(r[0])} * px + {_D(r[1])} * py + {_D(r[2])} * pz + {_F(o)})::double, 3) {a}" for r, o, a in zip(m, t, "xyz", strict=True)) + " from kept"


def _rpy(r: str, p: str, y: str) -> list[list[str]]:
    return [
        [f"cos({y}) * cos({p})", f"cos({y}) * sin({p}) * sin({r}) - sin({y}) * cos({r})", f"cos({y}) * sin({p}) * cos({r}) + sin({y}) * sin({r})"],
        [f"sin({y}) * cos({p})", f"sin({y}) * sin({p}) * sin({r}) + cos({y}) * cos({r})", f"sin({y}) * sin({p}) * cos({r}) - cos({y}) * sin({r})"],
        [f"-sin({p})", f"cos({p}) * sin({r})", f"cos({p}) * cos({r})"],
    ]

ORACLE = {
    "range_filter": _CTE + "select frame_id, point_idx from near",
    "every_nth": _CTE + "select frame_id, point_idx from kept",
    "nearest_pose": _CTE + f"select frame_id, stamp_us, pose_seq, dt_us from ({_ASOF})",
    "lookup_pose": _CTE + _SLERP,
    "last_poses": _CTE + "select pose_seq, stamp_us from poses order by pose_seq desc limit 100",
    "crop_xy": _CTE + f"select frame_id, point_idx from world where abs(wx) <= {_F(2.5)} and abs(wy) <= {_F(2.5)}",
    "world_points": _CTE + f"""select frame_id, point_idx, round((c * px - s * py + tx)::double, 3) x, round((s * px + c * py + ty)::double, 3) y, round(pz::double, 3) z
  from (select k.frame_id, k.point_idx, px, py, pz, tx, ty, {_F(1)} - ({_F(2)} * qz) * qz c, ({_F(2)} * qz) * qw s from kept k join ({_ASOF}) a on k.frame_id = a.frame_id)""",
    "direction_bins": _CTE + "select bin, count(*) n from based group by 1",
    "stencil_l2": _L2,
    "stencil_l1": _L1,
    "kernel": f"with stencil as ({_L2}), dirs as ({_DIRS}) select bin, sum({_OCC}) occupied, sum(rank) ranks from stencil cross join dirs group by 1",
    "touched_cells": _CTE + _TOUCHED,
    "voxel_map": _CTE + "select *, cast((1 << rank) - 1 as int) d from voxels",
    "resident_map": _CTE + "select * from voxels",
    "map_merge": _CTE + "select * from voxels",
    "surface_cloud": _CTE + "select x, y, z from placed where rank <= 1 and occupied",
    "surface_every_second": _CTE + "select x, y, z from placed where rank <= 1 and occupied and vx % 2 = 0 and vy % 2 = 0 and vz % 2 = 0",
    "dense_cells": _CTE + f"""select cx, cy, cz, coalesce(v.rank, 16) d_manhattan, case when v.occupied then 0 else 1 end s, coalesce(v.hits, 0) hits, {", ".join(f"round((cc.i{a} + 0.5::double) / 10 - 16, 6) {a}" for a in "xyz")}
  from (select *, {", ".join(f"c{a} * 10 + v{a} i{a}" for a in "xyz")} from (select distinct cx, cy, cz from placed where occupied) cross join {_FULL.format(10)}) cc left join voxels v using (ix, iy, iz)""",
    "occupied_centres": _CTE + "select cx, cy, cz, x, y, z from placed where occupied",
    "voxel_lookup": _CTE + f"select probe_id, ix, iy, iz, {_READ} from (select probe_id, {_AT} from probes) left join voxels v using (ix, iy, iz)",
    "voxel_walk": _CTE + f"select probe_id, step, ix, iy, iz, {_READ} from (select probe_id, cast(step as int) step, cast(ix + step as int) ix, iy, iz from (select probe_id, {_AT} from probes) cross join (select unnest(range(8)) step)) left join voxels v using (ix, iy, iz)",
    "trilinear": _CTE + f"""select probe_id, {", ".join(f"{c} a{i}" for i, c in enumerate(_COEF))}, round({" + ".join(f"({c}) * {t}" for c, t in zip(_COEF, _TERM, strict=True))}, 4) as value
  from (select probe_id, {", ".join(f"(any_value({a}) - (any_value(j{a}) / 10.0::double - 16)) * 10 u{a}" for a in "xyz")}, {_CORNER}
  from (select p.*, c, coalesce(v.rank, 16) rank from (select probe_id, x, y, z, {", ".join(f"i{a} j{a}" for a in "xyz")}, c, ix + c % 2 ix, iy + (c // 2) % 2 iy, iz + c // 4 iz
  from (select probe_id, x, y, z, {_AT} from probes) cross join (select unnest(range(8)) c)) p left join voxels v using (ix, iy, iz)) group by 1)""",
    "signed_field": _CTE + f"""select cx, cy, cz, sum(case when v.occupied then 1 else 0 end) inside, count(*) samples
  from (select *, {", ".join(f"c{a} * 10 + v{a} i{a}" for a in "xyz")} from (select distinct {", ".join(f"c{a} - k{a} as c{a}" for a in "xyz")} from placed cross join {" cross join ".join(f"(select unnest([0, 1]) k{a}) u{a}" for a in "xyz")} where occupied and {" and ".join(f"(k{a} = 0 or v{a} = 0)" for a in "xyz")}) semi join ({_TOUCHED}) using (cx, cy, cz) cross join {_FULL.format(11)}) cc left join voxels v using (ix, iy, iz) group by 1, 2, 3""",
    "scan_counters": _CTE + f"select (select count(distinct frame_id) from scans) frames_in, (select count(distinct frame_id) from scans) - (select count(*) from ({_ASOF})) frames_dropped, (select count(*) from kept k join ({_ASOF}) a on k.frame_id = a.frame_id) points_kept",
    "in_grid": _WIDE + " and ".join(f"w{a} > -15 and w{a} < 15" for a in "xyz"),
    "kernel_fits": _WIDE + " and ".join(f"w{a} - {_F(0.4)} > -15 and w{a} + {_F(0.4)} < 15" for a in "xyz"),
    "transform_yaw": _turned([["cos(0.7::double)", "-sin(0.7::double)", "0"], ["sin(0.7::double)", "cos(0.7::double)", "0"], ["0", "0", "1"]]),
    "transform_rpy": _turned(_rpy(_ROLL, _PITCH, _YAW)),
    "pose_latest_zero_stamp": _CTE + """select frame_id, round(tx::double, 6) tx, round(ty::double, 6) ty, round(qw::double, 6) qw, round(qz::double, 6) qz
  from scans join (select *, row_number() over (partition by pose_seq % 3 order by stamp_us desc, pose_seq desc) r from poses) p on frame_id % 3 = pose_seq % 3 and r = 1""",
    "pose_chain": _CTE + """, latest as (select *, pose_seq % 2 = 0 even from (select *, row_number() over (partition by pose_seq % 2 order by stamp_us desc, pose_seq desc) r from poses) where r = 1)
  select frame_id, round(a.tx::double + (1 - 2 * a.qz::double * a.qz) * b.tx - 2 * a.qw::double * a.qz * b.ty, 6) tx, round(a.ty::double + 2 * a.qw::double * a.qz * b.tx + (1 - 2 * a.qz::double * a.qz) * b.ty, 6) ty,
  round(a.qw::double * b.qw - a.qz::double * b.qz, 6) qw, round(a.qw::double * b.qz + a.qz::double * b.qw, 6) qz from scans cross join (from latest where even) a cross join (from latest where not even) b""",
    "cell_residency_no_evict": _CTE + f"select cx, cy, cz, min(frame_id) alloc_frame from ({_TOUCHED}) group by 1, 2, 3",
    "rank_table": f"select distinct r2, rank, mask from ({_stencil(5, 'dense_rank() over (order by r2) - 1')})",
    "kernel_preview": f"select ox, oy, rank, occ, 1 - occ sign from (select ox, oy, rank, {_OCC.replace('25', '9')} occ from ({_stencil(3, 'dense_rank() over (order by r2) - 1')}) cross join (select * from ({_DIRS}) where bin = 805) where oz = 0)",
    "published_cloud": _CTE + f"""select k.frame_id, stamp_us, 'odom' frame, point_idx, round((c * px - s * py + tx)::double, 3) x, round((s * px + c * py + ty)::double, 3) y, round(pz::double, 3) z
  from (select k.frame_id, k.point_idx, stamp_us, px, py, pz, tx, ty, {_F(1)} - ({_F(2)} * qz) * qz c, ({_F(2)} * qz) * qw s from kept k join ({_ASOF}) a on k.frame_id = a.frame_id) k""",
}
