import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_lines import brute as lines
from tests.llm.test_minhash import brute as near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    step = dict(C.STAGES)
    a = C.cut(step["quality"](spark, docs, SF))
    kept = {r.doc_id for r in a.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and a.columns == C.COLUMNS
    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = C.cut(step["lines"](spark, a, SF))
    want = {i: t for (i, old), t in lines(rows, 50).items() if t == old or t.strip()}
    assert {r.doc_id: r.text for r in b.collect()} == want
    c = C.cut(step["near"](spark, b, SF))
    assert {r.doc_id for r in c.collect()} == {i for i, (_, comp) in near(list(want.items()), 5, 80).items() if comp == i}
    d = C.cut(step["decontaminate"](spark, c, SF))
    left = [(r.doc_id, r.text) for r in c.collect()]
    assert {r.doc_id for r in d.collect()} == {i for i, _ in left} - {i for i, _ in leaks(left, items)}
    e = step["pack"](spark, d, SF).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in d.collect()}


def test_null_ids_and_repeated_rows(spark):
    t = "one two three four five six seven eight"
    rows = [(1, t, None, None, 5), (1, t, None, None, 5), (None, t, "en", "s", None), (2, None, None, None, None), (3, "", None, None, 0), (1, "quite another text that shares the id of the first one", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in C.near(spark, df, SF).collect())
    assert got == ["1", "1", "2", "3"]  # a copy without an id goes, another text with the same id stays
    left = {"quality": 6, "lines": 6, "near": 4, "decontaminate": 6, "pack": 6}
    for name, f in C.STAGES:
        assert f(spark, df, SF).count() == left[name], name
        assert f(spark, df.where("false"), SF).count() == 0, name


def test_stages_return_heap(spark):
    """Each stage begins with a full collection: what the one before has left is no longer held beside Python workers."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full():
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, f in C.STAGES:
        before = full()
        f(spark, docs, SF)
        assert full() > before, name
