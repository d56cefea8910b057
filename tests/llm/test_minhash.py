import random
import re

import pytest

from voxmap.llm import op7_minhash as M

SF = "/root/testdata/sf0.01"


def brute(rows, width, percent):
    """Class by class over plain Python sets."""
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for width in (2, 5):
        want = brute(rows, width, 80)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, width, 80).collect()}
        assert got == want


def test_edges(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (6, " ".join(w)), (7, " ".join(w)), (8, " ".join(w[:36])), (9, " ".join(w[:32])), (10, "É é"), (11, "é é"), (None, "one"), (None, "lonely words here"), (12, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' as key", "1 as p", "2 as size", "4 as d", "5 as t1", "3 as comp", "'n' as rep")
    got = {r.doc_id: r for r in M.near_duplicates(df, 2, 80).where("doc_id is not null").collect()}
    assert got[1].n_shingles == 0 and got[1].kept and got[3].component_id == 3
    assert got[5].component_id == 4 and not got[5].kept
    assert {got[i].component_id for i in (6, 7, 8, 9)} == {6}
    assert got[11].component_id == 11 and got[12].kept
    lost = [r for r in M.near_duplicates(df, 2, 80).where("doc_id is null").collect()]
    assert sorted(str(r.component_id) for r in lost) == ["4", "None"] and not any(r.kept for r in lost)
    assert M.near_duplicates(df.where("false"), 2, 80).count() == 0


def test_large_group_needs_no_pair_per_pair(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 150] + [f"n{i}"] + base[i % 150 + 1 :])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(df, 5, 80).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_copies_cost_a_pair_a_member(spark, monkeypatch):
    """300 near copies fall into several buckets a band; each first meets one pivot, not that of every bucket."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"n{i}" if j in (i % 150, (7 * i + 60) % 150) else w for j, w in enumerate(base))) for i in range(300)]
    seen, plain = [], M.alike

    def counted(pairs, sketches):
        seen.append(pairs.count())
        return plain(pairs, sketches)

    monkeypatch.setattr(M, "alike", counted)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.component_id for r in got} == {0}
    assert seen[0] < len(rows) and sum(seen) < 2 * len(rows), seen


def test_pivots_stand_amid_their_group(spark, monkeypatch):
    """300 near copies of one text, which is there once, link with it and not with each other: it is to be the pivot."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        own = set(rng.sample(range(200), 8))
        rows.append((i, " ".join(f"n{i}x{j}" if j in own else w for j, w in enumerate(base))))
    seen, plain = [], M.alike

    def counted(pairs, sketches):
        seen.append(pairs.count())
        return plain(pairs, sketches)

    monkeypatch.setattr(M, "alike", counted)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 3 * len(rows), seen
