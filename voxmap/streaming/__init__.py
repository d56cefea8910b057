"""Incremental maps: each micro-batch is folded and merged into the stored map; order and batching do not matter."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.config import MapConfig
from voxmap.operators.integrate import VOXEL, contributions, finish, integrate, merge


class MapStore:
    """A stored map in versions; a batch that is run again writes the same version again, from the version before it."""

    def __init__(self, spark: SparkSession, path: str, cfg: MapConfig):
        self.spark, self.path, self.cfg = spark, path, cfg

    def _fs(self, sub: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        f, p = self._fs("")
        if not f.exists(p):
            return []
        names = [s.getPath().getName() for s in f.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and f.exists(self._fs(f"{n}/_SUCCESS")[1]))

    def read(self, below: int | None = None) -> DataFrame | None:
        v = [x for x in self.versions() if below is None or x < below]
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def add(self, points: DataFrame, batch: int) -> None:
        new = integrate(points, self.cfg)
        old = self.read(batch)
        (merge(old, new, self.cfg) if old is not None else new).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        for v in self.versions():
            if v < batch - 1:
                f, p = self._fs(f"v{v}")
                f.delete(p, True)

    def clear(self) -> None:
        f, p = self._fs("")
        f.delete(p, True)


def stream_to_store(points: DataFrame, store: MapStore, checkpoint: str):
    """World points (wx..wz, sx..sz) as a stream into a stored map."""
    return points.writeStream.foreachBatch(lambda df, i: store.add(df, i)).option("checkpointLocation", checkpoint).start()


def live_map(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """The map as a streaming aggregate (update or complete mode): one state row per voxel, no pre-aggregation."""
    one = points.drop("frame_id") if "frame_id" in points.columns else points
    base = _ungrouped(one, cfg)
    return finish(contributions(base, cfg).groupBy(*VOXEL).agg(F.min("rank").alias("rank"), F.sum("n").alias("hits")), cfg)


def _ungrouped(points: DataFrame, cfg: MapConfig) -> DataFrame:
    """As hits() without its aggregate: a stream takes one stateful aggregate here."""
    from voxmap.functions import direction_bin, f32
    from voxmap.operators.filters import kernel_fits

    step = f32(cfg.radius * cfg.res)
    base = [F.floor((F.col(w) - f32(o) - step) * f32(float(cfg.per_metre))).cast("int").alias(b) for w, o, b in zip(("wx", "wy", "wz"), cfg.origin, ("bx", "by", "bz"), strict=True)]
    b = direction_bin(*[F.col(f"w{a}") - F.col(f"s{a}") for a in "xyz"], cfg.bins_az, cfg.bins_el).alias("bin")
    return points.where(kernel_fits(cfg)).select(b, *base, F.lit(1).alias("n"))


__all__ = ["MapStore", "live_map", "stream_to_store"]
