import os
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest

from voxmap import queries as q
from voxmap.engine import VoxelMap
from voxmap.config import CODE_DEFAULTS, MapConfig
from voxmap.operators import cells, export, filters, integrate, kernel, mesh, pose
from voxmap.plans import build_map, world_points
from voxmap.sources import cloud_files
from voxmap.streaming import MapStore, live_map, stream_to_store

SF = "/root/testdata/sf0.001"
CFG = MapConfig((-4.0,) * 3, (4.0,) * 3, 0.1, 10_000, 1.0, 50.0, 1, 2, 40, 40, 6, "L2", 5)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "events", "supplier", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_oracle(spark, duck, name):
    g, w = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLE[name]).df()
    cols = sorted(g.columns)
    assert cols == sorted(w.columns) and len(g) == len(w) > 0
    text = [c for c in cols if g[c].dtype == object or str(g[c].dtype) in ("str", "string")]
    assert all(sorted(g[c]) == sorted(w[c]) for c in text)
    g, w = (d.drop(columns=text)[[c for c in cols if c not in text]].astype(float).pipe(lambda x: x.sort_values(list(x.columns))).to_numpy() for d in (g, w))
    assert np.abs(g - w).max() < 1e-9


def world(spark, rows):
    return spark.createDataFrame([(*map(float, r), 0.0, 0.0, 0.0) for r in rows], "wx float, wy float, wz float, sx float, sy float, sz float")


def test_one_point(spark):
    p = [(1.03, 0.52, 0.21)]
    one, two = MapConfig(**{**CFG.__dict__, "occ_min_hits": 1}), CFG
    v = integrate.integrate(world(spark, p), one)
    assert v.count() == 125 and v.where("occupied").count() == 63 and v.where("rank <= 1 and occupied").count() == 4
    once, twice = (integrate.integrate(world(spark, p * n), two) for n in (1, 2))
    assert once.where("occupied").count() == 0 and once.where("hits = 1").count() == 63
    assert sorted(map(tuple, twice.select("ix", "iy", "iz", "rank", "occupied").collect())) == sorted(map(tuple, v.select("ix", "iy", "iz", "rank", "occupied").collect()))


def test_kernel_tables():
    k = [r[5] for r in kernel.stencil_rows(CFG)]
    assert sum(k) == 690 and [n for _, n in sorted(Counter(k).items())] == [1, 6, 12, 8, 6, 24, 24, 12, 24, 8]
    assert sum(r[5] for r in kernel.stencil_rows(CODE_DEFAULTS)) == 10_890
    assert sum(r[5] for r in kernel.stencil_rows(MapConfig(distance_mode="L2"))) == 19_342
    assert MapConfig(kernel_size=6).kernel_size == 7
    with pytest.warns(UserWarning):
        assert MapConfig(distance_mode="L9").distance_mode == "L1"
    for bad in ({"res": 0.3}, {"every": 0}, {"occ_min_hits": 256}, {"occ_min_hits": 0}):
        with pytest.raises(ValueError):
            MapConfig(**bad)


def serial(rows, cfg):
    return {(*k, a, int(h), bool(h >= cfg.occ_min_hits)) for k, (a, h) in serial_raw(rows, cfg).items()}


def serial_raw(rows, cfg):
    """A plain fold over numpy float32 numbers: voxel to (rank, capped hits)."""
    f, m, st, dirs = np.float32, {}, kernel.stencil_rows(cfg), kernel.bin_directions(cfg)
    for r in rows:
        w = [f(x) for x in r]
        x, y, z = map(float, w)
        n = np.sqrt(x * x + y * y + z * z)
        az = np.arctan2(y, x) + (2 * np.pi if np.arctan2(y, x) < 0 else 0)
        b = min(39, int((np.arcsin(z / n) + np.pi / 2) * 40 / np.pi)) * 40 + min(39, int(az * 40 / (2 * np.pi)))
        base = [int(np.floor((v - f(-4) - f(0.2)) * f(10))) for v in w]
        d = dirs[b]
        for _, ox, oy, oz, r2, rank, _ in st:
            occ = r2 == 0 or (d[0] * f(ox) + d[1] * f(oy) + d[2] * f(oz) >= 0 and r2 <= cfg.shadow_radius**2)
            key = (base[0] + ox + 2, base[1] + oy + 2, base[2] + oz + 2)
            a, h = m.get(key, (16, 0))
            m[key] = (min(a, rank), min(cfg.occ_min_hits, h + occ))
    return {k: (a, int(h)) for k, (a, h) in m.items()}


def test_fold_streams_and_merges(spark, tmp_path):
    rnd = random.Random(3)
    rows = [tuple(rnd.uniform(-1.5, 1.5) for _ in range(3)) for _ in range(80)]
    want = serial(rows, CFG)
    assert set(map(tuple, integrate.integrate(world(spark, rows), CFG).collect())) == want
    a, b = (integrate.integrate(world(spark, rows[i::2]), CFG) for i in (0, 1))
    assert set(map(tuple, integrate.merge(b, a, CFG).collect())) == want
    src = str(tmp_path / "src")
    for i in range(3):
        world(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("wx float, wy float, wz float, sx float, sy float, sz float").option("maxFilesPerTrigger", 1).parquet(src)
    store = MapStore(spark, str(tmp_path / "map"), CFG)
    s = stream_to_store(stream, store, str(tmp_path / "cp"))
    s.processAllAvailable()
    s.stop()
    assert set(map(tuple, store.read().collect())) == want and len(store.versions()) == 2
    store.clear()
    assert store.read() is None
    s = live_map(stream, CFG).writeStream.outputMode("complete").format("memory").queryName("live").start()
    s.processAllAvailable()
    s.stop()
    assert set(map(tuple, spark.table("live").collect())) == want


def numbered(spark, rows):
    """World points of (frame, x, y, z) rows in their order, seen from the origin."""
    return spark.createDataFrame([(r[0], i, *r[1:], 0.0, 0.0, 0.0) for i, r in enumerate(rows)], "frame_id long, point_idx long, wx float, wy float, wz float, sx float, sy float, sz float").repartition(3)


def plain_ring(requests, capacity):
    """Residencies by the letter of the ring: one request after the other, nothing skipped."""
    slot, log, n = [None] * capacity, [], 0
    for frame, cell in requests:
        if all(s is None or log[s][0] != cell for s in slot):
            if slot[n % capacity] is not None:
                log[slot[n % capacity]][2] = frame
            slot[n % capacity] = len(log)
            log.append([cell, frame, None])
            n += 1
    return Counter(map(tuple, log))


def plain_requests(rows, cfg):
    f = np.float32
    for frame, *w in rows:
        axes = []
        for v, lo, hi, o in zip(w, cfg.low, cfg.high, cfg.origin, strict=True):
            at = [f(f(v) + f(k)) for k in (-1, 0, 1)]
            axes.append([int(np.floor(x - f(o))) for x in at if f(lo + 1) < x < f(hi - 1)])
        yield from ((frame, (x, y, z)) for z in axes[2] for y in axes[1] for x in axes[0])


def test_fifo_and_residency(spark):
    rnd = random.Random(1)
    for _ in range(300):
        cap, req = rnd.randint(1, 4), [(i // 3, [rnd.randint(0, 6) for _ in range(rnd.randint(0, 3))]) for i in range(20)]
        flat = [(f, c) for f, cs in req for c in cs]
        assert Counter(cells.fifo(req, cap)) == plain_ring(flat, cap)
    for cap in (1, 20, 30, 45, 60, 10_000):
        few = MapConfig(**{**CFG.__dict__, "max_cells": cap})
        rows = [(i // 4, *(float(f"{rnd.uniform(-3.9, 3.9):.3f}") for _ in range(3))) for i in range(40)]
        rows[9] = rows[8]
        pts = numbered(spark, rows)
        got = Counter((((r.cx, r.cy, r.cz), r.alloc_frame, r.evict_frame)) for r in cells.residency(pts, few).collect())
        assert got == plain_ring(plain_requests(rows, few), cap), cap


def test_writes_to_evicted_cells_are_dropped(spark):
    """Against a loop over frames: cells are allocated for a whole frame first, then its points are integrated."""
    few = MapConfig(**{**CFG.__dict__, "max_cells": 30})
    rows = [(0, 1.5, 1.5, 1.5), (0, -1.5, -1.5, -1.5), (1, 1.5, 1.5, 1.5), (2, 0.04, 1.5, -1.5), (2, 1.5, 1.5, 1.5)]
    pts = numbered(spark, rows)
    got = set(map(tuple, integrate.integrate_resident(pts, few, cells.residency(pts, few)).collect()))
    ring = plain_ring(plain_requests(rows, few), 30)
    since = {c: f for (c, f, e) in ring if e is None}
    want = set()
    per = {f: serial_raw([r[1:] for r in rows if r[0] == f], few) for f in range(3)}
    for k in {k for m in per.values() for k in m}:
        c = tuple(i // 10 for i in k)
        seen = [per[f][k] for f in per if c in since and f >= since[c] and k in per[f]]
        if seen:
            hits = min(few.occ_min_hits, sum(h for _, h in seen))
            want.add((*k, min(a for a, _ in seen), hits, hits >= few.occ_min_hits))
    whole = set(map(tuple, integrate.integrate(pts, few).collect()))
    assert got == want and got != whole and got


def rows_joined(df):
    """The rows that the joins of df make, when it runs."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        x = todo.pop()
        name = x.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(x.executedPlan())
        elif "QueryStage" in name:
            todo.append(x.plan())
        if "Join" in name:
            n += x.metrics().apply("numOutputRows").value()
        todo += [x.children().apply(i) for i in range(x.children().size())]
    return n


def test_resident_cells_meet_points_not_voxels(spark):
    """400 points in 40 frames: a point meets the cells of its stencil (8 at most), not its 125 voxels."""
    rnd = random.Random(5)
    spots = [tuple(float(f"{rnd.uniform(-2, 2):.3f}") for _ in range(3)) for _ in range(10)]
    pts = numbered(spark, [(f, *s) for f in range(40) for s in spots])
    out = integrate.integrate_resident(pts, CFG, cells.residency(pts, CFG))
    assert 400 <= rows_joined(out) <= 400 * 10
    assert set(map(tuple, out.collect())) == set(map(tuple, integrate.integrate(pts, CFG).collect()))


def test_filters_and_poses(spark):
    nan = float("nan")
    p = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 1, nan, 0.0, 0.0), (1, 2, 0.5, 0.0, 0.0), (1, 3, 3.0, 0.0, 0.0), (1, 4, 2.0, 0.0, 0.0)], "frame_id long, point_idx long, px float, py float, pz float")
    r = filters.range_filter(p, 1, 2)
    assert sorted(x.point_idx for x in r.collect()) == [0, 1, 4] and sorted(x.point_idx for x in filters.every_nth(r, 2).collect()) == [0, 4]
    w = pose.to_world_rpy(p.where("point_idx = 0"), 1, 2, 3, 0.0, 0.0, np.pi / 2).first()
    y = pose.to_world_yaw(p.where("point_idx = 0"), 1, 2, 3, np.pi / 2).first()
    assert np.allclose([w.wx, w.wy, w.wz], [1, 3, 3], atol=1e-6) and np.allclose([y.wx, y.wy, y.wz], [1, 3, 3], atol=1e-6)
    s = spark.createDataFrame([(1, 1000), (2, 0)], "frame_id long, stamp_us long")
    i = pose.identity_pose(s)
    assert i.count() == 2 and world_points(p, i, CFG).count() > 0 and build_map(p, i, CFG, evict=True).count() > 0
    rows = [(0, 500, "o", "c", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (1, 1500, "o", "c", 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    poses = spark.createDataFrame(rows, "pose_seq long, stamp_us long, parent string, child string, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    got = {r.frame_id: r for r in pose.lookup_pose(s.selectExpr("*", "'o' as parent", "'c' as child"), poses).collect()}
    assert abs(got[1].tx - 1) < 1e-9 and abs(got[1].qz - np.sqrt(0.5)) < 1e-9 and got[2].tx == 2


def test_writers(spark, tmp_path):
    v = integrate.integrate(world(spark, [(1.03, 0.52, 0.21)] * 2), CFG)
    s = export.surface(v, CFG)
    assert export.save_pcd(s, f"{tmp_path}/a.pcd") == export.save_ply(s, f"{tmp_path}/b.ply") == 4
    back = cloud_files(spark, f"{tmp_path}/*.p*").collect()
    want = sorted((round(r.x, 4), round(r.y, 4), round(r.z, 4)) for r in s.collect())
    for kind in (".pcd", ".ply"):
        assert sorted((round(r.px, 4), round(r.py, 4), round(r.pz, 4)) for r in back if r.path.endswith(kind)) == want
    assert export.save_pcd(s.where("false"), f"{tmp_path}/none.pcd") == 0 and not (tmp_path / "none.pcd").exists()
    assert export.save_cell_csv(v, CFG, f"{tmp_path}/cells") == export.occupied_cells(v, CFG).count()
    one = next((tmp_path / "cells").glob("*.csv")).read_text().splitlines()
    assert one[0] == "x,y,z,d_manhattan,s,hits" and len(one) == 1001
    t = mesh.triangles(v, CFG)
    n = mesh.save_mesh(t, f"{tmp_path}/m.stl")
    raw = (tmp_path / "m.stl").read_bytes()
    assert struct.unpack("<I", raw[80:84])[0] == n > 0 and len(raw) == 84 + 50 * n
    assert mesh.save_mesh(t, f"{tmp_path}/m.vtp") == n
    with pytest.raises(ValueError):
        mesh.save_mesh(t, f"{tmp_path}/m.obj")


def test_marching_cubes_is_closed():
    rng = np.random.default_rng(0)
    for k in range(5):
        v = np.ones((7, 7, 7))
        v[1:6, 1:6, 1:6] = rng.choice([-1.0, 1.0], (5, 5, 5))
        t = np.round(mesh.march(v), 6)
        edges = Counter()
        for a, b, c in t:
            for x, y in ((a, b), (b, c), (c, a)):
                edges[tuple(x), tuple(y)] += 1
        assert len(t) and all(edges[y, x] == n for (x, y), n in edges.items())
    ball = np.linalg.norm(np.indices((21, 21, 21)) - 10, axis=0) - 6
    t = mesh.march(ball)
    vol = abs(np.einsum("ni,ni->n", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6)
    assert abs(vol - 4 / 3 * np.pi * 216) / vol < 0.03


def test_mesh_covers_cells_that_see_a_neighbours_voxels(spark):
    """A patch in the first layer of its cell: the cell below it is meshed too, in step with a plain loop."""
    v = spark.createDataFrame([(x, y, 40, 0, 3, True) for x in range(38, 43) for y in range(32, 36)] + [(35, 35, 35, 0, 1, False)], "ix int, iy int, iz int, rank int, hits int, occupied boolean")
    occupied = {(r.ix, r.iy, r.iz) for r in v.where("occupied").collect()}
    want = {}
    for c in np.ndindex(8, 8, 8):
        s = np.full((11, 11, 11), 0.1)
        for p in np.ndindex(11, 11, 11):
            if tuple(np.array(c) * 10 + p) in occupied:
                s[p] = -0.1
        if (s < 0).any():
            want[c] = len(mesh.march(s))
    got = Counter((r.cx, r.cy, r.cz) for r in mesh.triangles(v, CFG, smoothing=False).collect())
    assert got == Counter(want) and set(want) == {(3, 3, 3), (3, 3, 4), (4, 3, 3), (4, 3, 4)}
    some = spark.createDataFrame([(3, 3, 3), (4, 3, 4), (7, 7, 7)], "cx int, cy int, cz int")
    assert {(r.cx, r.cy, r.cz) for r in mesh.triangles(v, CFG, smoothing=False, allocated=some).collect()} == {(3, 3, 3), (4, 3, 4)}


def test_lookup_across_buckets_and_chains(spark):
    """Poses that stand in other buckets than the scan, and two links turned by quarter turns."""
    h = 0.5**0.5
    rows = [(0, 10, "a", "b", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (1, 1010, "a", "b", 10.0, 0.0, 0.0, h, 0.0, 0.0, h), (2, 10, "b", "c", 1.0, 0.0, 0.0, h, h, 0.0, 0.0), (3, 1010, "b", "c", 1.0, 0.0, 0.0, h, h, 0.0, 0.0)]
    poses = spark.createDataFrame(rows, "pose_seq long, stamp_us long, parent string, child string, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    scans = spark.createDataFrame([(1, 510), (2, 1010), (3, 5), (4, 1011), (5, 0), (6, 10)], "frame_id long, stamp_us long")
    for width in (7, 100, 5000):
        one = {r.frame_id: r for r in pose.lookup_pose(scans.selectExpr("*", "'a' as parent", "'b' as child"), poses, width).collect()}
        assert sorted(one) == [1, 2, 5, 6] and [round(one[i].tx, 9) for i in (1, 2, 5, 6)] == [5.0, 10.0, 10.0, 0.0]
        assert abs(one[1].qz - np.sin(np.pi / 8)) < 1e-9
    path = pose.frame_path(poses, "a", "c")
    assert path == ["a", "b", "c"]
    got = {r.frame_id: tuple(round(v, 9) for v in r[1:]) for r in pose.lookup_chain(scans, poses, path).collect()}
    assert sorted(got) == [1, 2, 5, 6] and got[6] == (1.0, 0.0, 0.0, round(h, 9), round(h, 9), 0.0, 0.0)
    assert got[2] == got[5] == (10.0, 1.0, 0.0, 0.5, 0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        pose.frame_path(poses, "c", "a")


def test_facade(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 2.03, 0.52, 0.21)], "frame_id long, point_idx int, px float, py float, pz float")
    scans = spark.createDataFrame([(1, 5)], "frame_id long, stamp_us long")
    m = VoxelMap(MapConfig(**{**CFG.__dict__, "occ_min_hits": 1}), str(tmp_path)).load(points, scans).integrate()
    assert m.voxels.count() == 125
    for path in (m.save_pcd(), m.save_ply(), m.save_csv(), m.save_mesh()):
        assert os.path.exists(path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["grid_data.pcd", "grid_data.ply", "grid_data_csv", "mesh.stl"]
