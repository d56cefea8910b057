"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of the corpus' principal components and ordered by the first. Blocks of that
order are compared tile by tile. Two blocks whose first coordinates are further apart than sqrt(2 - 2 * threshold) can
hold no link and never meet. In a tile the leading components are accumulated first; the rest of a dot product is
bounded by the product of the two suffix norms, and a pair is dropped as soon as the sum cannot reach the threshold.
Survivors go on with more components; the last test is the cosine of the given vectors in double precision.

Equal vectors are one class (counted, not compared). Links are counted inside a tile and never emitted as pairs: a tile
gives, per vector with links, their number and one spanning edge, so a hot group costs rows in proportion to its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths are not compared; a row with a null vec_id links with nothing, has a null component_id and kept =
false; repeated rows count as vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm._util import components, cut, table

BLOCK, TILE, LEAD = 4096, 1024, 16
SLACK = 1e-4  # single precision and rotation errors of a bound are far below this


def matrices(col: pa.Array):
    """(rows, matrix) for each vector length of a list column; only usable vectors."""
    n = len(col)
    ok = np.asarray(col.is_valid())
    off = np.asarray(col.offsets).astype(np.int64)
    flat = col.values
    bad = ~np.asarray(flat.is_valid()) if flat.null_count else None
    x = np.asarray(flat.fill_null(0) if flat.null_count else flat)
    size = np.where(ok, np.diff(off), 0)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        at = off[rows][:, None] + np.arange(d)
        m = x[at]
        good = np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1) > 0)
        if bad is not None:
            good &= ~bad[at].any(axis=1)
        if good.any():
            yield rows[good], m[good]


def units(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _moments(batches):
    """Second moments of unit vectors: (d, i, row i of the d x d matrix) of a partition, in one pass."""
    acc: dict[int, np.ndarray] = {}
    for b in batches:
        for _, m in matrices(b.column(0)):
            u = units(m)
            d = u.shape[1]
            acc[d] = acc.get(d, 0) + u.T @ u
    for d, s in acc.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.repeat(np.arange(d), d), pa.int32()), pa.array(np.tile(np.arange(d), d), pa.int32()), pa.array(s.ravel())], ["d", "i", "j", "v"])


def _prepare(basis: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            n = b.num_rows
            dim, d1, d2, x1 = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            raw: list[bytes | None] = [None] * n
            for rows, m in matrices(b.column(1)):
                m = m + m.dtype.type(0)  # -0.0 is 0.0
                dim[rows] = m.shape[1]
                x1[rows] = units(m) @ basis[m.shape[1]][:, 0]
                for r, v in zip(rows.tolist(), m, strict=True):
                    raw[r] = v.tobytes()
                    d1[r], d2[r] = np.frombuffer(hashlib.blake2b(raw[r], digest_size=16).digest(), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim), pa.array(d1), pa.array(d2), pa.array(x1), pa.array(raw, pa.binary())], ["vec_id", "dim", "d1", "d2", "x1", "raw"])

    return run


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges (i, j) on n nodes."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        m = np.minimum(lab[i], lab[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def tile_links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool, tile: int = TILE, lead: int = LEAD):
    """Yields (i, j) index arrays of the links between rows of a and rows of b, tile by tile; same: a is b, i is not j."""
    # each row over its largest component: squares neither overflow nor vanish, and the cosine stays
    a, b = (x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True).astype(np.float64) for x in (a, b))
    ua, ub = units(a) @ basis, units(b) @ basis
    d = ua.shape[1]
    na, nb = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (a, b))
    steps = [k for k in (lead, 2 * lead) if k < d]
    suffix = {k: tuple(np.sqrt(np.maximum((u[:, k:] ** 2).sum(axis=1), 0)) for u in (ua, ub)) for k in steps}
    if steps:
        fa, fb = (np.column_stack([u[:, : steps[0]], s]).astype(np.float32) for u, s in zip((ua, ub), suffix[steps[0]], strict=True))
    for lo in range(0, len(a), tile):
        hi = min(lo + tile, len(a))
        i = None
        if steps:
            i, j = np.nonzero(fa[lo:hi] @ fb.T >= threshold - SLACK)
            i += lo
            if same:
                i, j = i[i != j], j[i != j]
        if i is None or len(i) > 64 * (hi - lo):  # many survive: the whole tile in double precision is cheaper
            i, j = np.nonzero((a[lo:hi].astype(np.float64) @ b.T.astype(np.float64)) >= threshold * np.outer(na[lo:hi], nb) * (1 - 1e-12))
            i += lo
            if same:
                i, j = i[i != j], j[i != j]
        elif len(steps) > 1:
            k = steps[1]
            s = np.einsum("nd,nd->n", ua[i, :k], ub[j, :k]) + suffix[k][0][i] * suffix[k][1][j]
            i, j = i[s >= threshold - SLACK], j[s >= threshold - SLACK]
        keep = []
        for p in range(0, len(i), 1 << 16):
            x, y = a[i[p : p + (1 << 16)]].astype(np.float64), b[j[p : p + (1 << 16)]].astype(np.float64)
            keep.append(np.einsum("nd,nd->n", x, y) / (na[i[p : p + (1 << 16)]] * nb[j[p : p + (1 << 16)]]) >= threshold)
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        yield i[ok], j[ok]


def _pair(basis: dict[int, np.ndarray], threshold: float, kind: str):
    def run(t: pa.Table) -> pa.Table:
        block, ids, n = (t.column(c).to_numpy() for c in ("block", "rep", "n"))
        d = int(t.column("dim")[0].as_py())
        m = np.frombuffer(b"".join(t.column("raw").to_pylist()), kind).reshape(len(ids), d)
        first = block == block.min()
        same = bool(first.all())
        ia = np.flatnonzero(first)
        ib = ia if same else np.flatnonzero(~first)
        links, pi, pj = np.zeros(len(ids), np.int64), [], []
        for i, j in tile_links(m[ia], m[ib], basis[d], threshold, same):
            links += np.bincount(ia[i], weights=n[ib[j]], minlength=len(ids)).astype(np.int64)
            if not same:
                links += np.bincount(ib[j], weights=n[ia[i]], minlength=len(ids)).astype(np.int64)
            if len(i):
                lab = _stars(ia[i], ib[j], len(ids))
                x = np.flatnonzero(lab != np.arange(len(ids)))
                pi.append(x)
                pj.append(lab[x])
        lab = _stars(np.concatenate(pi), np.concatenate(pj), len(ids)) if pi else np.arange(len(ids))
        # the node that stands for a local component may be any of its members
        has = np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(ids[has]), "links": pa.array(links[has]), "other": pa.array(ids[lab[has]])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding array<float or double>)."""
    spark = vectors.sparkSession
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding").cast("array<double>") if wide else F.col("embedding")).alias("embedding"))
    moments = base.select("embedding").mapInArrow(_moments, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()  # d * d numbers per vector length
    basis: dict[int, np.ndarray] = {}
    for d in {r.d for r in moments}:
        s = np.zeros((d, d))
        for r in moments:
            if r.d == d:
                s[r.i, r.j] = r.v
        basis[d] = np.linalg.eigh((s + s.T) / 2)[1][:, ::-1].copy()
    ready = cut(base.mapInArrow(_prepare(basis), "vec_id long, dim int, d1 long, d2 long, x1 double, raw binary"), "vectors")
    usable = ready.where("dim > 0 and vec_id is not null")
    classes = cut(usable.groupBy("d1", "d2").agg(F.min(F.struct("vec_id", "dim", "x1", "raw")).alias("m"), F.count(F.lit(1)).alias("n")).select("d1", "d2", "n", F.col("m.vec_id").alias("rep"), F.col("m.dim").alias("dim"), F.col("m.x1").alias("x1"), F.col("m.raw").alias("raw")), "classes")
    total = classes.count()
    key = ready.select("vec_id", "d1", "d2", (F.col("dim") > 0).alias("usable"))
    if total > 1:
        blocks = cut(classes.repartitionByRange(-(-total // block), "dim", "x1", "rep").select("rep", "n", "dim", "x1", "raw", F.spark_partition_id().alias("block")), "blocks")
        # which blocks can hold a link: a row per block, an equi-join on the stretches of the first coordinate they cover
        reach = float(np.sqrt(2 - 2 * threshold)) + SLACK if threshold < 1 else SLACK
        ends = cut(blocks.groupBy("dim", "block").agg(F.min("x1").alias("low"), F.max("x1").alias("top")), "ends")
        cell = lambda x: F.floor(x / F.lit(max(reach, 1 / 64)))  # noqa: E731  no block covers more than 130 of them
        one = ends.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("top") + reach))).alias("cell"))
        two = ends.select(*[F.col(c).alias(f"_{c}") for c in ends.columns], F.explode(F.sequence(cell(F.col("low")), cell(F.col("top")))).alias("_cell"))
        later = (F.col("_low") > F.col("low")) | ((F.col("_low") == F.col("low")) & (F.col("_block") >= F.col("block")))
        meet = one.join(two, (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))).where(later & (F.col("_low") - F.col("top") <= reach)).select("dim", F.col("block").alias("u"), F.col("_block").alias("v")).distinct()
        todo = meet.select("dim", F.explode(F.array_distinct(F.array("u", "v"))).alias("block"), F.struct("u", "v").alias("pair"))
        dealt = blocks.join(todo, ["dim", "block"]).select("block", "rep", "n", "dim", "raw", "pair")
        found = cut(dealt.groupBy("dim", "pair").applyInArrow(_pair(basis, threshold, "<f8" if wide else "<f4"), "id long, links long, other long"), "links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
        classes = classes.join(links, classes.rep == links.id, "left").drop("id").join(comp, F.col("rep") == F.col("node"), "left")
    else:
        classes = classes.withColumn("links", F.lit(None).cast("long")).withColumn("comp", F.lit(None).cast("long"))
    of = classes.select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("comp", "rep").alias("comp"), F.lit(True).alias("hit"))
    out = key.join(of, ["d1", "d2"], "left")
    live = F.col("usable") & F.col("hit").isNotNull() & F.col("vec_id").isNotNull()
    cid = F.when(live, F.col("comp")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(live, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))


def op5_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


SQL = """with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(embedding) > 0),
good as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id id, vec_id c from embeddings union select l.b, r.c from reach r join links l on l.a = r.id)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from embeddings
join (select id, min(c) component_id from reach group by id) on id = vec_id left join (select a, count(*) n from links group by a) on a = vec_id"""
