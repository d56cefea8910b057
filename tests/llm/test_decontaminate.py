import random
from collections import Counter

import regex

from voxmap.llm import op2_decontaminate as D

SF = "/root/testdata/sf0.01"


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def brute(docs, items, width=5, percent=80):
    out, at = {}, {}
    goals = []
    for i, t in items:
        w = words(t)
        if w:
            k = min(width, len(w))
            goals.append((i, k, Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    for d, text in docs:
        v = words(text)
        for k in {g[1] for g in goals}:
            at[d, k] = [tuple(v[j : j + k]) for j in range(len(v) - k + 1)]
        for i, k, goal in goals:
            m, sh = sum(goal.values()), at[d, k]
            size = min(m, len(sh))
            spots = [j for j, s in enumerate(sh) if s in goal]
            for s in sorted({x for j in spots for x in range(max(0, j - size + 1), min(j, len(sh) - size) + 1)}) if 2 * len(spots) >= m else []:
                o = sum((Counter(sh[s : s + size]) & goal).values())
                if (100 + percent) * o >= percent * (m + size):
                    out[d, i] = max(out.get((d, i), 0), o / (m + size - o))
    return out


def test_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in D.op2_decontaminate(spark, SF).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_edited_passages(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([12, 25, 40, 80])))) for i in range(25)]
    docs = []
    for d in range(150):
        w = items[rnd.randrange(25)][1].split()
        for _ in range(rnd.randint(0, 2 + len(w) // 12)):
            p = rnd.randrange(len(w))
            w[p : p + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
        docs.append((d, " ".join([rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] + w + [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))])))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert want and {(r.d, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_repeated_shingles(spark):
    rnd = random.Random(7)
    items, docs = [], []
    for i in range(12):  # one shingle more of the other kind
        a, b = f"a{i}", f"b{i}"
        items.append((i, " ".join([a, b] * 6 + [a])))
        docs.append((i, " ".join([b, a] * 6 + [b])))
    for i in range(12, 24):  # a run of one word in a passage of distinct words
        w = [f"v{i}x{j}" for j in range(400)]
        items.append((i, " ".join(w)))
        p = rnd.randrange(100, 250)
        docs.append((i, " ".join(w[:p] + ["la"] * 40 + w[p + 40 :])))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) == 24 and {(r.d, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "One two, THREE four five six seven."), (4, "One two, THREE four five six seven."), (None, "one two three four five six seven"), (5, "ab"), (6, "x ab y"), (7, "la " * 300), (8, "one two three four five")]
    items = [(10, "one two three four five six seven"), (11, None), (12, "!"), (13, "Ab"), (14, "la la la la la la la la"), (15, "ONE two three four five six seven")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as pos", "3 as len", "4 as words", "5 as d")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.d, r.item_id) for r in D.leaks(df, it).collect()}
    assert got == {(4, 10), (4, 15), (None, 10), (None, 15), (5, 13), (6, 13), (7, 14)}
    assert sorted(str(r.doc_id) for r in D.clean(df, it).collect()) == ["1", "2", "3", "8"]
    assert D.clean(df.where("false"), it).count() == 0 and D.clean(df, it.where("false")).count() == len(docs)


def test_recall_by_item_size(spark):
    rnd = random.Random(11)
    sizes = (13, 25, 50, 120)
    items = [(100 * n + i, " ".join(f"i{n}x{i}x{rnd.randrange(60)}" for _ in range(n))) for n in sizes for i in range(10)]
    docs = []
    for i, text in items:
        for part in (0.9, 0.93, 0.97):  # the rest of the passage is missing, so some are just above the threshold
            w = text.split()
            docs.append((len(docs), " ".join(["before"] * 3 + w[: round(part * len(w))] + [f"o{rnd.random()}" for _ in range(len(w))])))
    got = {(r.d, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set(brute(docs, items))
    assert got <= want
    for n in sizes:
        mine = {x for x in want if x[1] // 100 == n}
        assert mine and len(mine & got) >= 0.999 * len(mine), n
