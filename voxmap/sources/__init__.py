"""Scan and pose sources: tables, streams, and point cloud files read by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCAN = "frame_id long, stamp_us long, sensor_frame string, point_idx int, px float, py float, pz float"
POSES = "pose_seq long, stamp_us long, parent string, child string, tx double, ty double, tz double, qw double, qx double, qy double, qz double"


def scans(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """Scan points; as a stream, files are played back one (or more) per trigger."""
    return spark.readStream.schema(SCAN).option("maxFilesPerTrigger", files_per_trigger).parquet(path) if stream else spark.read.schema(SCAN).parquet(path)


def poses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return spark.readStream.schema(POSES).parquet(path) if stream else spark.read.schema(POSES).parquet(path)


def parse_cloud(raw: bytes) -> np.ndarray:
    """x, y, z (float32) of a PCD or PLY file, ASCII or binary with float fields."""
    end = raw.index(b"end_header\n") + 11 if raw.startswith(b"ply") else raw.index(b"\n", raw.index(b"DATA ")) + 1
    head = raw[:end].decode("ascii", "replace")
    lines = [x.split() for x in head.splitlines()]
    if raw.startswith(b"ply"):
        names = [x[2] for x in lines if x[:1] == ["property"] and len(x) == 3]
        text = any(x[:2] == ["format", "ascii"] for x in lines)
        n = next(int(x[2]) for x in lines if x[:2] == ["element", "vertex"])
    else:
        names = next(x[1:] for x in lines if x[:1] == ["FIELDS"])
        text = any(x[:2] == ["DATA", "ascii"] for x in lines)
        n = next(int(x[1]) for x in lines if x[:1] == ["POINTS"])
    at = [names.index(a) for a in "xyz"]
    if text:
        return np.array(raw[end:].split(), np.float32).reshape(n, len(names))[:, at]
    return np.frombuffer(raw, "<f4", n * len(names), end).reshape(n, len(names))[:, at]


def cloud_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_idx, px, py, pz) of all PCD and PLY files under a path."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = parse_cloud(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.arange(len(p), dtype=np.int32)), *(pa.array(p[:, i].copy()) for i in range(3))], ["path", "point_idx", "px", "py", "pz"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, point_idx int, px float, py float, pz float")
