"""Cell allocation and first-in first-out residency."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.functions import f32

CELL = ["cx", "cy", "cz"]


def cell_of(cfg: MapConfig, *axes) -> list:
    return [F.floor(c - f32(o)).cast("int").alias(n) for c, o, n in zip(axes, cfg.origin, CELL, strict=True)]


def touched_cells(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """(frame_id, cell) of the up to 27 cells around each point that are in the grid.

    One axis after the other: rows become distinct cells of that axis before the next one multiplies them.
    """
    p = points.select("frame_id", "wx", "wy", "wz")
    for a in ("wx", "wy", "wz"):
        p = p.withColumn(a, F.explode(F.array(*[F.col(a) + f32(k) for k in (-1.0, 0.0, 1.0)])))
        lo, hi = cfg.low["xyz".index(a[1])], cfg.high["xyz".index(a[1])]
        p = p.where((F.col(a) > f32(lo + 1)) & (F.col(a) < f32(hi - 1)) & ~F.isnan(a)).withColumn(a, F.floor(F.col(a) - f32(cfg.origin["xyz".index(a[1])])).cast("int"))
        p = p.distinct()
    return p.select("frame_id", *[F.col(a).alias(c) for a, c in zip(("wx", "wy", "wz"), CELL, strict=True)])


def fifo(requests: Iterable[tuple], capacity: int) -> Iterator[tuple]:
    """(cell, frame of allocation, frame of eviction or None) for requests (frame, cells) in order: a ring of slots.

    Evictions are yielded as they happen, resident cells at the end, so only the ring is held.
    """
    slot, at, n, settled = [None] * capacity, {}, 0, None
    for frame, cells in requests:
        if cells == settled:
            continue
        new = 0
        for cell in cells:
            if cell not in at:
                i = n % capacity
                if slot[i] is not None:
                    yield slot[i], at.pop(slot[i]), frame
                slot[i], at[cell], n, new = cell, frame, n + 1, new + 1
        # the same cells again change nothing where all were resident
        settled = None if new else cells
    for cell, frame in at.items():
        yield cell, frame, None


def first_frames(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """(cell, alloc_frame): the first frame that touches the cell.

    Points that touch the same cells become one row, in each task already, before their up to 27 cells are made.
    """
    near = {}
    for a, lo, hi, o in zip("xyz", cfg.low, cfg.high, cfg.origin, strict=True):
        for k in (-1, 0, 1):
            v = F.col(f"w{a}") + f32(float(k))
            near[f"{a}{k + 1}"] = F.when((v > f32(lo + 1)) & (v < f32(hi - 1)) & ~F.isnan(v), F.floor(v - f32(o)).cast("int"))
    p = points.select("frame_id", *[c.alias(n) for n, c in near.items()]).groupBy(*near).agg(F.min("frame_id").alias("frame_id"))
    for a, c in zip("xyz", CELL, strict=True):
        p = p.withColumn(c, F.explode(F.array(*[f"{a}{k}" for k in range(3)]))).where(F.col(c).isNotNull())
    return p.groupBy(*CELL).agg(F.min("frame_id").alias("alloc_frame"))


def residency(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """(cell, alloc_frame, evict_frame): while the cells fit, every one from its first frame on; else the ring's fold.

    Requests come in the order of frame, point, then z, y, x of the 27 cells around the point; a cell that is evicted
    within a frame and requested again is allocated again. The fold is sequential by nature: points are sorted into one
    task, which streams them and holds the ring only. The usual case (distinct cells within max_cells) is a plain
    aggregate and never comes there; its rows, max_cells at most, are taken at once, so the points are read once for it.
    """
    first = first_frames(points, cfg)
    rows = first.limit(cfg.max_cells + 1).collect()
    if len(rows) <= cfg.max_cells:
        return points.sparkSession.createDataFrame(rows, first.schema).withColumn("evict_frame", F.lit(None).cast("long"))
    order = [c for c in ("frame_id", "point_idx", "wx", "wy", "wz") if c in points.columns]
    steps = np.float32([-1, 0, 1])

    def requests(batches):
        for batch in batches:
            frames = batch.column(0).to_pylist()
            axes = []
            for i in range(3):
                v = batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float32)[:, None] + steps
                ok = (v > np.float32(cfg.low[i] + 1)) & (v < np.float32(cfg.high[i] - 1))
                c = np.floor(np.where(ok, v, 0) - np.float32(cfg.origin[i])).astype(np.int64)
                axes.append([[int(k) for k, good in zip(*row, strict=True) if good] for row in zip(c, ok, strict=True)])
            for frame, xs, ys, zs in zip(frames, *axes, strict=True):
                yield frame, [(x, y, z) for z in zs for y in ys for x in xs]

    def fold(batches):
        rows = fifo(requests(batches), cfg.max_cells)
        while part := list(itertools.islice(rows, 50_000)):
            cell, first, last = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([*[pa.array([c[i] for c in cell], pa.int32()) for i in range(3)], pa.array(first, pa.int64()), pa.array(last, pa.int64())], [*CELL, "alloc_frame", "evict_frame"])

    one = points.select("frame_id", "wx", "wy", "wz", *[c for c in order if c == "point_idx"]).repartition(1).sortWithinPartitions(*order)
    return one.mapInArrow(fold, "cx int, cy int, cz int, alloc_frame long, evict_frame long")
