"""Shared plumbing: the cluster's shared folder, written tables, ranks in two levels, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster's executors need a shared folder")
        d = getattr(spark, "_voxmap_shared", None)
        if not d:
            d = "file://" + tempfile.mkdtemp(prefix="voxmap-")
            spark._voxmap_shared = d
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: bytes of an Arrow batch between the JVM and a Python worker (Spark's own bound is 64 MB); both sides hold several
ARROW_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_BYTES, however long the texts, for jobs run inside; a bound set in the session stays."""
    own = spark.conf.get(_BYTES, None) is not None
    if not own:
        spark.conf.set(_BYTES, str(ARROW_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(_BYTES)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxmap_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_voxmap_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back(spark: SparkSession) -> None:
    """A full collection in the JVM of each executor, which returns the heap that earlier steps have left to the system.

    A JVM keeps what it once grew to, up to its bound, while its Python workers need memory beside it. There are more
    tasks than cores, so each executor gets some; one that is missed, or that ignores such calls, only keeps its heap.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(rows: int, per_block: int = 20_000) -> int:
    """Number of blocks: it grows with the rows, so that a block stays small."""
    return max(1, math.ceil(rows / per_block))


def ranked(df: DataFrame, keys: list[str], order: list, spread: list, rows: int, out: str = "rank", per_block: int = 20_000) -> DataFrame:
    """A gapless rank from 0 within keys, in two levels: a hash block's rank, plus the rows of the key's earlier blocks.

    No key is gathered in one task: a key with a third of all rows is spread over rows / per_block blocks. Blocks come
    in block number order, rows in a block by `order`; rows that tie on everything are interchangeable.
    """
    n = blocks_for(rows, per_block)
    b = df.withColumn("_block", F.pmod(F.xxhash64(*spread), F.lit(n)))
    start = (
        b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_start")
    )
    local = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(start, on).withColumn(out, F.col("_start") + F.col("_r") - 1).drop("_block", "_b", "_start", "_r", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): (node, comp), comp the smallest node; nodes without edges are absent.

    Alternating large-star and small-star steps. Each step is a map-side combined minimum and an equi-join, so a node
    with very many neighbours is neither gathered nor collected; each round is a written table.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        nxt = cut(small, "cc")
        forget(e)
        now, e = mark(nxt), nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


class Members:
    """A test that every row of keys passes, and few others: a bitmap of hashed keys, made by the executors.

    It has about 64 bits a key and MOST_BITS bits (8 MB) at most, so it may be sent to all tasks whatever the input. Two
    bits are set for a key; with more than a million keys more and more other rows pass. It only spares a shuffle the
    rows that can't match: whoever uses it joins or counts what is left, so the number of keys changes no result.
    """

    MOST_BITS = 1 << 26

    def __init__(self, keys: DataFrame, *cols: str):
        n = keys.count()
        self.bits = min(self.MOST_BITS, 1 << max(12, (64 * n - 1).bit_length() if n else 0))
        at = keys.select(F.explode(F.array(*self._places([F.col(c) for c in cols]))).alias("at"))
        words = at.groupBy((F.shiftright("at", 6)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        every = keys.sparkSession.range(self.bits // 64)
        dense = every.join(words, every.id == words.word, "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("m"))
        self.map = cut(dense.select(F.transform("m", lambda x: x.bits).alias("m")), "members").scalar()

    def _places(self, cols: list) -> list:
        h, mask = F.xxhash64(*cols), F.lit(self.bits - 1)
        return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]

    def has(self, *cols):
        """A condition: these values may be a key."""
        out = None
        for p in self._places(list(cols)):
            word = F.get(self.map, F.shiftright(p, 6).cast("int"))
            one = F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            out = one if out is None else out & one
        return out


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))
