import random

from voxmap.llm import op3_lines as L

SF = "/root/testdata/sf0.01"


def brute(rows, words):
    """Longest previous factor over plain lists: a line goes if a run of `words` words that covers it began earlier too."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" ")] for *_, t in docs]
    at: dict = {}
    gone = [set() for _ in docs]
    for d, seq in enumerate(seqs):
        for p in range(len(seq)):
            here = seq[p][1]
            for e, q in at.get(here, []):
                other, n = seqs[e], 0
                while p + n < len(seq) and q + n < len(other) and seq[p + n][1] == other[q + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in seq[p : p + n]) >= words:
                    gone[d].update(k for k, _ in seq[p : p + n])
            at.setdefault(here, []).append((d, p))
    return {(None if o else i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for (o, i, t), g in zip(docs, gone, strict=True)}


def check(spark, rows, words):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as name", "2 as q", "3 as m", "4 as line", "5 as d")
    want = brute(rows, words)
    got = L.dedup_lines(df, words).collect()
    assert len(got) == len(rows)
    from hashlib import md5

    assert sorted((str(r.doc_id), md5(str(r.text).encode()).hexdigest()) for r in got) == sorted((str(i), md5(str(want.get((i, t))).encode()).hexdigest()) for i, t in rows)


def test_random_texts(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        pool = [" ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 6))) for _ in range(12)]
        runs = [[rnd.choice(pool) for _ in range(rnd.randint(1, 9))] for _ in range(5)]
        rows = []
        for i in range(40):
            body = []
            for _ in range(rnd.randint(0, 6)):
                body += rnd.choice(runs) if rnd.random() < 0.5 else [rnd.choice(pool) if rnd.random() < 0.4 else f"only {i} {rnd.random()}"] + [""] * rnd.randint(0, 1)
            rows.append((i, "\n".join(body)))
        check(spark, rows, 10)


def test_edges(spark):
    long = "a b c d e f g h i j"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, long), (5, long), (None, long), (6, f"x\n{long}\ny"), (7, "\n".join([long] * 4)), (8, "z " * 200_000), (9, "z " * 200_000), (10, "short\nshort")]
    check(spark, rows, 10)
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_does_not_grow_with_levels(spark):
    """The levels of the doubling are written one by one: what is left joins twice at most, with 5 words or with 50."""
    rows = [(i, "\n".join(["a", "b", "c", "d"] * 20)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (5, 50):
        plan = L.repeated_lines(df, words)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= 2, words


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 50)
