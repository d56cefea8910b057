"""Minimum-cost-flow resharding.

Documents lie in old shards in hash blocks. A transport network (old shard -> new shard, cost 1 a byte unless the shard
stays the same, capacities of the new shards) is solved by successive shortest paths: a block or part of a block moves
only where the flow says so, and the bytes moved are the fewest possible. The flow of an old shard cuts its byte range
into intervals; a document goes where its middle byte lies, so a shard misses its capacity by about one document.

The query writes the documents as the old layout (a folder per shard, each row with a key of its own), rewrites the
affected shards whole (staged, then put in place of the old folders) and takes its columns from the files it reads back.
Shards whose rows do not change are not rewritten. Texts are shuffled once, by (old shard, block): the second pass
places each document by the same rule as the first, so no row is joined with its text.

The driver sees one number per old shard. Positions are prefix sums in two levels (blocks, then inside a block), and the
number of blocks grows with the rows. Contents play no part: equal texts, however many, are spread like others.
Files are compressed with zstandard.

Defined results: size of a null text is 16, its checksum 0; rows with a null doc_id are hashed as the text ''; repeated
rows each get a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxmap.llm._util import blocks_for, cut, empty, new_path, table

OVERHEAD = 16


def min_cost_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} that places all sizes within the capacities and moves the fewest bytes.

    Successive shortest paths with potentials. Moving between different shards costs 1 a byte, staying costs 0.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities are too small")
    n, m = len(sizes), len(capacities)
    s, t = n + m, n + m + 1
    to, cap, cost, adj = [], [], [], [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            adj[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)

    for i, x in enumerate(sizes):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, int(i != j))
    for j, c in enumerate(capacities):
        edge(n + j, t, c, 0)
    pot = [0] * (n + m + 2)
    while True:
        dist, via = [float("inf")] * len(adj), [-1] * len(adj)
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in adj[a]:
                if cap[e] and (nd := d + cost[e] + pot[a] - pot[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if via[t] < 0:
            break
        top = max(d for d in dist if d < float("inf"))
        pot = [p + min(d, top) for p, d in zip(pot, dist, strict=True)]
        push, a = float("inf"), t
        while a != s:
            push, a = min(push, cap[via[a]]), to[via[a] ^ 1]
        a = t
        while a != s:
            cap[via[a]] -= push
            cap[via[a] ^ 1] += push
            a = to[via[a] ^ 1]
    return {(to[e ^ 1], to[e] - n): cap[e ^ 1] for i in range(n) for e in adj[i] if e % 2 == 0 and n <= to[e] < n + m and cap[e ^ 1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def intervals(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard the (first byte, new shard) of its intervals; what stays comes first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i in {a for a, _ in flow}:
        at, parts = 0, []
        for j in sorted((b for a, b in flow if a == i), key=lambda j: (j != i, j)):
            parts.append((at, j))
            at += flow[i, j]
        out[i] = parts
    return out


@dataclass
class Plan:
    """What places a row: the flow, and one row per old shard, block and (for first slots) new shard."""

    flow: dict[tuple[int, int], int]
    order: list[str]
    n_blocks: int
    flows: DataFrame
    starts: DataFrame
    first: DataFrame | None = None


def _placed(rows: DataFrame, p: Plan) -> DataFrame:
    """rows with block, shard, and the place r in their block and shard."""
    return (
        _blocked(rows, p.order, p.n_blocks)
        .withColumn("within", F.sum("size").over(Window.partitionBy("old", "block").orderBy(*p.order, "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(p.starts), ["old", "block"]).join(F.broadcast(p.flows), "old")  # a row per block, a row per old shard
        .withColumn("middle", F.col("at") + F.col("within") + F.expr("size div 2"))
        .withColumn("shard", F.expr("element_at(filter(parts, p -> p.lo <= middle), -1).shard"))
        .withColumn("r", F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("within", *p.order)))
        .drop("parts", "middle", "within", "at")
    )


def _blocked(rows: DataFrame, order: list[str], n_blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(n_blocks)).cast("int"))


def _slots(placed: DataFrame, p: Plan) -> DataFrame:
    return placed.join(F.broadcast(p.first), ["shard", "old", "block"]).withColumn("slot", F.col("first") + F.col("r") - 1).drop("first", "r", "block")


def plan(rows: DataFrame, capacities: list[int] | None, shards: int, order: list[str]) -> tuple[DataFrame, Plan] | None:
    """rows(old int, size long, and the columns of `order`) with `shard` and `slot`, and the plan; None without rows."""
    spark = rows.sparkSession
    old = rows.groupBy("old").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row per old shard
    if not old:
        return None
    sizes = [0] * (max(r.old for r in old) + 1)
    for r in old:
        sizes[r.old] = r.size
    flow = min_cost_flow(sizes, capacities or equal_capacities(sum(sizes), shards))
    n_blocks = blocks_for(max(r.n for r in old))
    starts = _blocked(rows, order, n_blocks).groupBy("old", "block").agg(F.sum("size").alias("bytes")).withColumn("at", F.sum("bytes").over(Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).drop("bytes")
    flows = spark.createDataFrame(list(intervals(flow).items()), "old int, parts array<struct<lo:long,shard:int>>")
    p = Plan(flow, order, n_blocks, flows, cut(starts, "starts"))
    placed = cut(_placed(rows, p), "placed")
    p.first = cut(placed.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n"), "first")
    return _slots(placed, p), p


def reshard(rows: DataFrame, capacities: list[int] | None, shards: int, order: list[str]) -> tuple[DataFrame, dict]:
    """rows(old int, size long, and the columns of `order`) with `shard` and `slot`, and the flow.

    rows must come from a written table. capacities: bytes of each new shard; None: all equal.
    """
    made = plan(rows, capacities, shards, order)
    if made is None:
        return rows.withColumn("shard", F.lit(None).cast("int")).withColumn("slot", F.lit(None).cast("long")), {}
    return made[0], made[1].flow


def affected(flow: dict[tuple[int, int], int]) -> set[int]:
    """The shards that lose or gain rows: only their files are rewritten."""
    return {x for (a, b), n in flow.items() if a != b and n for x in (a, b)}


def replace(rows: DataFrame, shards: set[int], uri: str) -> None:
    """Put rows(shard, slot, ...) in place of the files of the given shards in uri/shard=N; other shards stay as they are.

    The new files are staged beside uri and complete before an old folder is touched; old folders are put aside, and
    deleted after the last one is replaced. A shard without rows loses its folder.
    """
    spark = rows.sparkSession
    staged = f"{uri.rstrip('/')}-staged-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in (uri, f"{staged}/_old"):
        fs.mkdirs(path(p))
    for n in sorted(shards):
        here, new, aside = path(f"{uri}/shard={n}"), path(f"{staged}/shard={n}"), path(f"{staged}/_old/shard={n}")
        for a, b in ((here, aside), (new, here)):
            if fs.exists(a) and not fs.rename(a, b):
                raise OSError(f"{a.toString()} could not be renamed; old and new files of the shard are under {staged}")
    fs.delete(path(staged), True)


def rewrite(docs: DataFrame, assigned: DataFrame, flow: dict, uri: str, on: list[str]) -> set[int]:
    """Replace the files of affected shards in uri/shard=N by their new rows; other shards' files stay as they are.

    assigned: one row per row key `on`, with shard and slot (docs and assigned match null-safely on `on`).
    """
    todo = affected(flow)
    few = assigned.where(F.col("shard").isin(sorted(todo))).select(*[F.col(c).alias(f"_{c}") for c in on], "shard", "slot")
    cond = None
    for c in on:
        e = docs[c].eqNullSafe(few[f"_{c}"])
        cond = e if cond is None else cond & e
    replace(docs.join(few, cond).drop(*[f"_{c}" for c in on]).repartition("shard", F.expr("slot div 100000")), todo, uri)
    return todo


def measures(doc_id: str, text: str) -> list:
    """doc_id, size and text_crc32 of a document."""
    t = F.col(text).cast("string")
    return [
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
    ]


def hash_shard(shards: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def old_layout(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32 and the hash shard where each document lies before."""
    return docs.select(*measures("doc_id", "text"), hash_shard(shards).alias("old"))


def write_layout(docs: DataFrame, shards: int, uri: str) -> None:
    """The old layout: uri/shard=N with files of (doc, row); doc holds all columns of docs, row is a unique row key.

    docs must be read from files: a row's key is its place in its part of the input.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), hash_shard(shards).alias("shard"))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(uri)


def read_layout(spark: SparkSession, doc, uri: str) -> DataFrame:
    """The files of uri/shard=N: doc, row, and for rewritten shards the slot and the shard where a row lay before."""
    kind = T.StructType([T.StructField("doc", doc), T.StructField("row", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("old", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(kind).parquet(uri)


def reshard_files(spark: SparkSession, doc, uri: str, capacities: list[int] | None, shards: int) -> DataFrame | None:
    """Rewrite the layout in uri; its rows, read back: doc_id, size, text_crc32, shard, slot, old. None without rows."""
    of = lambda d, *more: d.select(*measures("doc.doc_id", "doc.text"), "row", *more)
    before = read_layout(spark, doc, uri)
    rows = cut(of(before, F.col("shard").alias("old")), "sizes")
    made = plan(rows, capacities, shards, ["doc_id", "text_crc32", "row"])
    if made is None:
        return None
    out, p = made
    todo = sorted(affected(p.flow))
    if todo:
        sources = sorted({a for a, b in p.flow if a in todo or b in todo})
        texts = of(before.where(F.col("shard").isin(sources)), "doc", F.col("shard").alias("old"))
        moved = _slots(_placed(texts, p), p).where(F.col("shard").isin(todo))
        replace(moved.select("doc", "row", "slot", "old", "shard"), set(todo), uri)
    after = read_layout(spark, doc, uri)
    new = of(after.where(F.col("shard").isin(todo)), "shard", "slot", "old").drop("row")
    if {b for _, b in p.flow} <= set(todo):
        return new
    # files of other shards hold no slots: a row has the one it was given
    given = out.where(~F.col("shard").isin(todo)).select("row", "slot")
    same = of(after.where(~F.col("shard").isin(todo)), "shard", F.col("shard").alias("old")).join(given, "row")
    return new.unionByName(same.drop("row"))


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten from 32 hash shards to 40 shards of equal bytes; law: bytes."""
    docs, uri = table(spark, sf_dir, "documents"), new_path(spark, "shards")
    write_layout(docs, 32, uri)
    out = reshard_files(spark, docs.schema, uri, None, 40)
    if out is None:
        return empty(spark, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, old_shard int")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
