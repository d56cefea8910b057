"""Line dedup on a suffix array of line ids, built by distributed prefix doubling.

A text's lines (blank ones aside) become ids; only ids that occur more than once can lie in a repeated run. Suffixes are
sorted by prefix doubling: rank j orders positions by their first 2^j lines, and rank j + 1 orders the pairs (rank j
here, rank j 2^j lines on). A rank is given by a range-partitioned sort of the distinct pairs, so it keeps their order
and is exact. Suffixes with equal first m lines are one interval of the suffix array with longest common prefix of at
least m; two overlapping ranks of 2^j <= m lines name it.

From each position the fewest lines that hold `min_words` words are taken, and likewise to each position; such a run
whose interval has an earlier position (doc_id, line) is a later copy and its lines go. Every maximal repeated run of
that many words is a union of such runs, so exactly its later copies are deleted, and lines of shorter runs stay. A run
needs min_words lines at most, so the number of doublings does not depend on the corpus.

DataFrame operations only. Every step is an equi-join, a map-side combined aggregate or a window over one document.

Defined results: texts that are null or without a repeated run stay as they are, blank lines always stay; rows that
repeat a (doc_id, text) count once and get the same result; a null doc_id comes after all others; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.llm._util import Members, cut, forget, table

MIN_WORDS = 50
KEY = ["d", "t1", "t2"]


def _key(doc_id, text) -> list:
    """The row key: doc_id (null last) and a 128-bit hash of the text."""
    return [doc_id.cast("long").alias("d"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _names(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct pairs with a name that keeps their order: partition of a range sort, then place in it."""
    d = pairs.select(*cols).distinct()
    return cut(d.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()), "names")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t1, t2, line) of every line of docs(doc_id, text) that lies in a later copy of a run; line counts from 0."""
    text = F.col("text").cast("string")
    full = r"posexplode(filter(transform(split(text, '\n'), (x, i) -> struct(i AS line, x AS x)), s -> length(trim(s.x)) > 0)) AS (n, s)"
    lines = docs.select(F.col("doc_id"), text.alias("text")).where("text is not null").select(*_key(F.col("doc_id"), F.col("text")), F.expr(full))
    # n counts the lines that are not blank
    lines = cut(lines.select(*KEY, "n", "s.line", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(7), "s.x").alias("h2"), F.size(F.split(F.trim("s.x"), r"\s+")).alias("w")), "lines")
    twice = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"), "twice")
    # lines that occur once go here, before a line is shuffled with its place; one that slips through harms nothing:
    # a run that holds it has no copy
    hits = lines.where(Members(twice, "h1", "h2").has("h1", "h2")).repartition(*KEY).dropDuplicates([*KEY, "line"])
    # runs of repeated lines, with nothing but blank lines between them; a line's first name is its hash
    hits = hits.select(*KEY, "line", "w", F.struct("h1", "h2").alias("name"), (F.col("n") - F.row_number().over(Window.partitionBy(*KEY).orderBy("n"))).alias("seg"))
    seg = Window.partitionBy(*KEY, "seg")
    run = hits.withColumn("all", F.sum("w").over(seg)).where(F.col("all") >= min_words).withColumn("q", F.row_number().over(seg.orderBy("line")).cast("int")).withColumn("before", F.sum("w").over(seg.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    ahead = seg.orderBy("before").rangeBetween(0, min_words - 1)
    run = run.withColumn("m", F.when(F.sum("w").over(ahead) >= min_words, F.count(F.lit(1)).over(ahead))).withColumn("after", F.col("before") + F.col("w"))
    back = seg.orderBy("after").rangeBetween(-(min_words - 1), 0)
    run = run.withColumn("b", F.when(F.sum("w").over(back) >= min_words, F.count(F.lit(1)).over(back)))
    level = cut(run.select(*KEY, "seg", "q", "line", "name", F.col("m").cast("int").alias("m"), F.col("b").cast("int").alias("b")), "level")
    forget(lines)
    whole = level.select(*KEY, "seg", "q", "line")
    # runs to look at: `m` lines from place q on; a run to a place begins b - 1 places before it
    wins = level.where("m is not null").select(*KEY, "seg", "q", "m").union(level.where("b is not null").select(*KEY, "seg", (F.col("q") - F.col("b") + 1).alias("q"), F.col("b").alias("m"))).distinct()
    wins = cut(wins, "runs")
    longest = wins.agg(F.max("m")).first()[0] or 0
    later, span = None, 1
    at = [*KEY, "seg", "q"]
    while span <= longest:
        own = wins.where((F.col("m") >= span) & (F.col("m") < 2 * span))
        end = level.select(*KEY, "seg", (F.col("q") + span).alias("stop"), F.col("name").alias("z"))
        ranked = _join(own, level.select(*at, F.col("name").alias("a")), at).withColumn("stop", F.col("q") + F.col("m"))
        ranked = _join(ranked, end, [*KEY, "seg", "stop"]).select(*at, "m", "a", "z")
        place = F.struct(F.col("d").isNull().alias("o"), F.col("d"), F.col("t1"), F.col("t2"), F.col("seg"), F.col("q"))
        groups = ranked.groupBy("m", "a", "z").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        # written at each level: a plan of all levels at once takes the driver's memory, at any size of input
        found = cut(ranked.join(groups, ["m", "a", "z"]).where(place != F.col("first")).select(*at, "m"), "found")
        later = found if later is None else later.union(found)
        if 2 * span <= longest:
            nxt = Window.partitionBy(*KEY, "seg").orderBy("q")
            pairs = cut(level.withColumn("a", F.col("name")).withColumn("z", F.lead("name", span).over(nxt)).where("z is not null").select(*at, "a", "z"), "pairs")
            level = cut(pairs.join(_names(pairs, ["a", "z"]), ["a", "z"]).select(*at, "name"), "level")
            forget(pairs)
        span *= 2
    if later is None:
        return whole.where("false").select(*KEY, "line")
    forget(wins)
    gone = later.select(*KEY, "seg", F.explode(F.sequence("q", F.col("q") + F.col("m") - 1)).alias("q")).distinct()
    return _join(whole, gone, at).select(*KEY, "line")


def _join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join where a null d equals a null d; one copy of the columns."""
    r = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in b.columns if c not in on])
    cond = None
    for c in on:
        e = a[c].eqNullSafe(r[f"_{c}"]) if c == "d" else a[c] == r[f"_{c}"]
        cond = e if cond is None else cond & e
    return a.join(r, cond).drop(*[f"_{c}" for c in on])


def split(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """docs that have none of keys(d, t1, t2), and those that may have one; the key of a row of docs.

    Only the second part needs a join, so only texts that are keyed, and few others, are shuffled.
    """
    own = _key(F.col("doc_id"), F.col("text").cast("string"))
    hit = F.coalesce(Members(keys, *KEY).has(*own), F.lit(False))
    return docs.where(~hit), docs.where(hit), own


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs whose key is not in keys(d, t1, t2), a written table."""
    rest, some, (d, t1, t2) = split(docs, keys)
    bad = keys.select(*[F.col(c).alias(f"_{c}") for c in KEY])
    return rest.union(some.join(bad, d.eqNullSafe(F.col("_d")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left_anti"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without later copies, and _removed: the numbers of the deleted lines (null: none)."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words).groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("_removed"))
    gone = cut(gone, "gone")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    rest, some, (d, t1, t2) = split(docs, gone)
    out = some.join(gone.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_removed"), d.eqNullSafe(F.col("_d")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left")
    # the lines are bound to a lambda's variable, or they would be split anew for each line
    left = F.expr(r"transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _removed), i -> get(l, i)), '\n'))[0]")
    out = out.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left)).drop("_d", "_t1", "_t2")
    return rest.withColumn("_removed", F.lit(None).cast("array<int>")).unionByName(out)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of runs of lines of 50 words or more."""
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("_removed", ","), F.lit("")).alias("removed_lines"))
