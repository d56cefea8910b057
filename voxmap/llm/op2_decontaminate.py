"""Benchmark decontamination with SimHash windows, a multi-index on Hamming blocks and exact weighted-shingle similarity.

Words are maximal runs of letters and digits, in lower case; shingles are `width` consecutive words (an item with fewer
words is one shingle). Windows have an item's size. The weight of a shingle is how often it occurs, and the similarity
of a window and an item is the sum of the smaller weights over the sum of the larger ones.

1. Windows. For each item size, windows start or end at a shingle that some item of that size holds (moving a window up
   to the next such shingle loses none), and hold as many of those shingles as the threshold asks for at least. This
   loses no match and tells no item from another. It is one pass over the texts against a bitmap of the items' shingles;
   the second pass hashes only the documents that have such a window, so no text is shuffled.
2. Candidates. Windows of one content are one. Each and every item get a 64-bit SimHash of their shingles, the n-th
   occurrence of a shingle hashed with n: all elements are distinct and weigh the same, and their Jaccard similarity is
   that of the weights. Fingerprints are cut in BLOCKS blocks. Two within RADIUS bits differ in RADIUS div BLOCKS bits at
   most in some block, so the index holds all values that near to each block of each item, and an equi-join on item size,
   block number and block value finds every pair within RADIUS. Only these pairs go on.
3. The exact similarity decides.

Step 1 loses nothing. In step 2 a window at similarity 0.8 differs in about 10 of 64 bits; more than RADIUS = 24 bits
differ with a probability below 1e-5, less above 0.8 (test_recall_by_item_size).

DataFrame operations only. The item side is broadcast while it has BROADCAST shingles at most and is shuffled beyond.

Defined results: null or wordless texts and items match nothing; rows that repeat a (doc_id, text) count once; a null
doc_id is reported as null; a document with fewer shingles than the item is one window; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.llm._util import Members, cut, empty, table
from voxmap.llm.op3_lines import KEY, _join, _key, without

WIDTH, PERCENT, RADIUS, BLOCKS, BROADCAST = 5, 80, 24, 5, 500_000


def _words(text: str):
    return F.array_remove(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, and hs: the hashes of the k-word shingles of the column words, in order; rows without a shingle go.

    The words are bound to a lambda's variable below a generator: inlined, they would be split anew for each shingle.
    """
    hs = f"explode(transform(array(words), w -> CASE WHEN size(w) >= {k} THEN transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k}))) END))"
    return df.select(*keys, F.expr(hs).alias("hs")).where("hs is not null")


def _simhash(rows: DataFrame, keys: list[str], n: str, keep: bool = False) -> DataFrame:
    """A 64-bit fingerprint per key from rows with a hash column h; n: the column with the number of rows of the key."""
    # two 32-bit counters in each sum
    lanes = rows.groupBy(*keys, n).agg(*[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{k}") for k in range(32)])
    fp = None
    for k in range(32):
        for part, shift in ((F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(f"s{k}", 32), k + 32)):
            bit = F.shiftleft((2 * part > F.col(n)).cast("long"), shift)
            fp = bit if fp is None else fp.bitwiseOR(bit)
    return lanes.select(*keys, *[n] * keep, fp.alias("fp"))


def _numbered(counts: DataFrame, c: str) -> DataFrame:
    """A row for each occurrence of a shingle: h is hashed with the occurrence's number; c: the column of counts."""
    return counts.withColumn("nth", F.explode(F.expr(f"sequence(1L, {c})"))).withColumn("h", F.xxhash64("h", "nth")).drop("nth", c)


def _blocks(fp: str) -> list:
    """(block number, width, bits) of a fingerprint's blocks."""
    cuts = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [(b, hi - lo, F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _index(prints: DataFrame, radius: int) -> DataFrame:
    """For each row and block, all block values within radius div BLOCKS bits: no, bits, and the columns of prints."""
    def around(b: int, w: int, bits):
        few = F.filter(F.sequence(F.lit(0), F.lit((1 << w) - 1)), lambda x: F.bit_count(x) <= radius // BLOCKS)
        return F.transform(few, lambda x: F.struct(F.lit(b).alias("no"), bits.bitwiseXOR(x.cast("long")).alias("bits")))

    near = [around(*x) for x in _blocks("fp")]
    return prints.select("*", F.explode(F.flatten(F.array(*near))).alias("b")).select(*prints.columns, "b.no", "b.bits")


def candidates(windows: DataFrame, goals: DataFrame, radius: int) -> DataFrame:
    """All (window columns, iid) of windows(.., k, m, fp) and goals(iid, k, m, fp) of equal k and m within radius bits."""
    parts = windows.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("no"), bits.alias("bits")) for b, _, bits in _blocks("fp")])).alias("b")).select(*windows.columns, "b.no", "b.bits")
    index = _index(goals.select("iid", F.col("k").alias("_k"), F.col("m").alias("_m"), "fp"), radius).select("iid", "_k", "_m", F.col("fp").alias("_fp"), F.col("no").alias("_no"), F.col("bits").alias("_bits"))
    # Spark's estimate of the index is that of the goals, so the join is named
    met = parts.hint("merge").join(index.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("m") == F.col("_m")) & (F.col("no") == F.col("_no")) & (F.col("bits") == F.col("_bits")))
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= radius).select(*[c for c in windows.columns if c != "fp"], "iid").distinct()


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(d, t1, t2, item_id, start, similarity): for each document and item that it holds, the most similar window."""
    spark = docs.sparkSession
    named = items.select("item_id", _words("text").alias("words")).where("size(words) > 0").withColumn("iid", F.xxhash64("words"))
    named = cut(named, "items")
    unique = named.select("iid", "words").dropDuplicates(["iid"]).withColumn("k", F.least(F.size("words"), F.lit(width)))
    widths = sorted(r.k for r in unique.select("k").distinct().collect())  # `width` rows at most
    if not widths:
        return empty(spark, "d long, t1 long, t2 long, item_id long, start int, similarity double")
    parts = None
    for k in widths:
        one = _hashed(unique.where(F.col("k") == k), ["iid", "k"], k).select("iid", "k", F.size("hs").alias("m"), F.explode("hs").alias("h"))
        parts = one if parts is None else parts.union(one)
    shingles = cut(parts.groupBy("iid", "k", "m", "h").agg(F.count(F.lit(1)).alias("c")), "item-shingles")
    known = Members(shingles, "h")
    small = shingles.count() <= BROADCAST
    side = F.broadcast if small else (lambda df: df)

    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").select(*_key(F.col("doc_id"), F.col("text")), _words("text").alias("words"))
    hits = None
    for k in widths:
        at = _hashed(texts, KEY, k).select(*KEY, F.lit(k).alias("k"), F.size("hs").alias("len"), F.posexplode("hs").alias("pos", "h")).where(known.has("h"))
        hits = at if hits is None else hits.union(at)
    hits = cut(hits, "hits")
    # which sizes of items hold the shingle; the window has least(m, len) shingles; with o in common the similarity is
    # o / (m + size - o)
    per = Window.partitionBy(*KEY, "k", "m")
    spots = hits.join(side(shingles.select("k", "h", "m").distinct()), ["k", "h"]).select(*KEY, "k", "m", "len", "pos").repartition(*KEY).dropDuplicates([*KEY, "k", "m", "pos"])
    spots = spots.withColumn("size", F.least("m", "len")).withColumn("need", F.ceil(percent * (F.col("m") + F.col("size")) / (100 + percent)))
    many = spots.withColumn("n", F.count(F.lit(1)).over(per)).where("n >= need")
    # places p .. p + size - 1, in units of the size
    over = "count(1) OVER (PARTITION BY d, t1, t2, k, m ORDER BY pos / size RANGE BETWEEN {} AND {})"
    many = many.withColumn("ahead", F.expr(over.format("CURRENT ROW", "0.9999999D FOLLOWING"))).withColumn("back", F.expr(over.format("0.9999999D PRECEDING", "CURRENT ROW")))
    starts = F.array(F.when((F.col("ahead") >= F.col("need")) & (F.col("pos") + F.col("size") <= F.col("len")), F.col("pos")), F.when(F.col("back") >= F.col("need"), F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1)))
    wins = cut(many.select(*KEY, "k", "m", "size", F.explode(starts).alias("start")).where("start is not null").distinct(), "windows")
    # the shingles of those windows, from the texts of those documents
    held = Members(wins.select(*KEY).distinct(), *KEY)
    few = texts.where(held.has(*KEY))
    rows = None
    for k in widths:
        one = _join(wins.where(F.col("k") == k), _hashed(few, KEY, k), KEY).select(*KEY, "k", "m", "size", "start", F.slice("hs", F.col("start") + 1, F.col("size")).alias("own"))
        rows = one if rows is None else rows.union(one)
    rows = cut(rows.select("*", F.xxhash64("own").alias("c1"), F.xxhash64(F.lit(7), "own").alias("c2")), "contents")
    content = ["c1", "c2", "k", "m", "size"]
    counts = cut(rows.select(*content, "own").dropDuplicates(content).select(*content, F.explode("own").alias("h")).groupBy(*content, "h").agg(F.count(F.lit(1)).alias("c")), "counts")
    # written: the fingerprint is a large expression, and its blocks would hold copies of it
    prints = cut(_simhash(_numbered(counts, "c"), ["c1", "c2", "k", "m"], "size"), "prints")
    goals = cut(_simhash(_numbered(shingles, "c"), ["iid", "k"], "m", keep=True), "goals")
    close = candidates(prints, goals, radius)
    met = counts.join(close, ["c1", "c2", "k", "m"]).join(side(shingles.select(F.col("iid").alias("_i"), F.col("h").alias("_h"), F.col("c").alias("_c"))), (F.col("iid") == F.col("_i")) & (F.col("h") == F.col("_h")))
    exact = met.groupBy(*content, "iid").agg(F.sum(F.least("c", "_c")).alias("o")).where(f"{100 + percent} * o >= {percent} * (m + size)")
    exact = exact.select(*content, "iid", (F.col("o") / (F.col("m") + F.col("size") - F.col("o"))).alias("similarity"))
    best = rows.select(*KEY, "start", *content).join(exact, content).groupBy(*KEY, "iid").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.join(named.select("iid", "item_id"), "iid").select(*KEY, "item_id", (-F.col("b.s")).cast("int").alias("start"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item."""
    return without(docs, cut(leaks(docs.select("doc_id", "text"), items).select(*KEY).distinct(), "leaks"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the most similar window's first word and similarity."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(F.col("d").alias("doc_id"), "item_id", "start", "similarity")
