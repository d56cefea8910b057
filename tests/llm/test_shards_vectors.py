import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voxmap.llm import op1_resharding as R
from voxmap.llm import op5_cosine as C
from voxmap.llm._util import cut

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(30))
def test_flow_moves_the_fewest_bytes(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 8))]
    caps = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 8))]
    if sum(caps) < sum(sizes):
        with pytest.raises(ValueError):
            R.min_cost_flow(sizes, caps)
        caps[-1] += sum(sizes) - sum(caps)
    flow = R.min_cost_flow(sizes, caps)
    assert [sum(n for (a, _), n in flow.items() if a == i) for i in range(len(sizes))] == sizes
    assert all(sum(n for (_, b), n in flow.items() if b == j) <= c for j, c in enumerate(caps))
    stay = sum(min(s, c) for s, c in zip(sizes, caps, strict=False))
    assert sum(n for (a, b), n in flow.items() if a == b) == stay


def test_resharding(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = R.op1_resharding(spark, SF).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in got) == Counter(list(want))
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r.size for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * biggest


def test_rewrite_touches_only_what_moves(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(400)] + [(5, "same"), (5, "same"), (None, None)], "doc_id long, text string")
    rows = cut(R.old_layout(df, 4), "sizes")
    sizes = {r.old: r.s for r in rows.groupBy("old").sum("size").withColumnRenamed("sum(size)", "s").collect()}
    caps = [sizes[0], sizes[1], sizes[2] - 500, sizes[3], 500]
    out, flow = R.reshard(rows, caps, 5, ["doc_id", "text_crc32"])
    assert R.affected(flow) == {2, 4} and out.count() == 403
    assert out.where("old <> shard and old <> 2").count() == 0
    done = R.rewrite(df, out.dropDuplicates(["doc_id"]), flow, str(tmp_path / "o"), ["doc_id"])
    assert done == {2, 4} and {r.shard for r in spark.read.parquet(str(tmp_path / "o")).select("shard").distinct().collect()} == {2, 4}
    assert R.op1_resharding is not None and R.reshard(cut(R.old_layout(df.where("false"), 4), "s"), None, 5, ["doc_id"])[0].count() == 0


def test_rewrite_replaces_the_files_of_a_layout(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(400)], "doc_id long, text string")
    uri = str(tmp_path / "o")
    df.select("*", R.hash_shard(4).alias("shard")).write.partitionBy("shard").parquet(uri)
    rows = cut(R.old_layout(df, 4), "sizes")
    out, flow = R.reshard(rows, None, 5, ["doc_id", "text_crc32"])
    R.rewrite(df, out, flow, uri, ["doc_id"])
    got = spark.read.parquet(uri).collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in got) == sorted((r.doc_id, "x" * (r.doc_id % 7), r.shard) for r in out.collect())


def test_layout_is_rewritten_whole(spark, tmp_path):
    src, uri = str(tmp_path / "d"), str(tmp_path / "o")
    base = [(i, f"text {i} " * (i % 9), i) for i in range(400)]
    spark.createDataFrame(base + [(5, "same", 1), (5, "same", 1), (None, None, 2), (None, "x", 3)], "doc_id long, text string, shard int").write.parquet(src)
    df = spark.read.parquet(src)
    R.write_layout(df, 4, uri)
    before = {n: sorted(p.name for p in (tmp_path / "o" / f"shard={n}").glob("*.parquet")) for n in range(4)}
    sizes = {r.old: r.s for r in R.old_layout(df, 4).groupBy("old").sum("size").withColumnRenamed("sum(size)", "s").collect()}
    got = R.reshard_files(spark, df.schema, uri, [sizes[0], sizes[1], sizes[2] - 2000, sizes[3], 2000], 5).collect()
    after = {n: sorted(p.name for p in (tmp_path / "o" / f"shard={n}").glob("*.parquet")) for n in range(5)}
    assert [after[n] == before[n] for n in range(4)] == [True, True, False, True] and after[4]
    files = R.read_layout(spark, df.schema, uri).collect()
    assert Counter(tuple(r.doc) for r in files) == Counter(tuple(r) for r in df.collect()) and len({r.row for r in files}) == 404
    assert Counter((r.doc.doc_id, zlib.crc32((r.doc.text or "").encode()), r.shard) for r in files) == Counter((r.doc_id, r.text_crc32, r.shard) for r in got)
    assert all(r.shard == r.old or (r.old, r.shard) == (2, 4) for r in got)
    for n in range(5):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in files)))
    assert not list(tmp_path.glob("*staged*"))
    R.write_layout(df.where("false"), 4, str(tmp_path / "e"))
    assert R.reshard_files(spark, df.schema, str(tmp_path / "e"), None, 5) is None


def test_query_columns_come_from_rewritten_files(spark):
    files = R.op1_resharding(spark, SF).inputFiles()
    assert files and all("/shard=" in f for f in files)


def brute(rows, t):
    vec = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            vec[i] = x / np.linalg.norm(x)
    ids = sorted(i for i, _ in rows)
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in vec:
        for b in vec:
            if a < b and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= t:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [4096, 60])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = np.random.default_rng(i // 6).normal(size=64)
        rows.append((i, [float(x) for x in (base + rng.normal(size=64) * rng.choice([0, 0.05, 0.16, 0.3])).astype(np.float32)]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [None] + [1.0] * 63), (1005, [1.0, 0.0]), (1006, [2.0, 0.001]), (1007, [-1.0, 0.0]), (1008, [float("inf")] * 64), (1009, [3.0]), (1010, [5.0])]
    rows += [(2000 + k, rows[7][1]) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as n", "3 as comp")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_vectors(df, 0.95, block).collect()}
    assert got == brute(rows, 0.95)


def test_vectors_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in C.near_vectors(df).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("None", 0, "None", False)]
    assert C.near_vectors(df.where("false")).count() == 0


def test_extreme_magnitudes(spark):
    from voxmap.llm.op5_cosine import near_vectors

    rows = [(1, [1e-200, 2e-200, 3e-200]), (2, [1e-200, 2e-200, 3.01e-200]), (3, [1e200, 2e200, 3e200]), (4, [-1e200, 2e200, 3e200]), (5, [1.0, 2.0, 3.02])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}
