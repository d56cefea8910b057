"""MinHash near-duplicate detection with circulant signatures.

Two permutations make every signature coordinate: the first (sigma) scatters shingles over a ring of 2^20 places, the
second (pi) ranks the places and is shifted circularly by k for coordinate k. So one contiguous read of pi gives all
coordinates of a shingle. Coordinates are banded; documents that share a band bucket are candidates, and links are
confirmed by exact Jaccard similarity on the full shingle sets of whole texts.

Hot groups: texts with one shingle set are one class from the start. Classes are ordered by the members of all their
buckets, most first, so that those amid a group, which most others link with, are its pivots. A class is first compared
with one pivot, the first member of most of its buckets; then, in buckets that hold several components still, with the
PIVOTS first members that are in others (stars: a few pairs a member, never all pairs). Buckets of PIVOTS + 1 members are done with that;
for larger ones that still hold several components, a prefix filter over their documents (shingles in one order;
two sets at the threshold share one of their first 20 %) gives every pair of different components that can still be a
link, so no link is lost. No bucket is gathered in a task and no bucket is capped.

Candidates go to the exact comparison if sizes allow the threshold and if a sketch (a byte of each coordinate) agrees in
more than SKETCH of its places: at similarity 0.8, of 128 places fewer than 60 % agree with a probability below 1e-7.

Only band keys that occur twice, and only texts that stand in a pair, are shuffled (`Members`). Joins do not depend on
Spark's size estimates, so a large input runs the plan of a small one.

Defined results: a null or blank text has an empty set and links with nothing; rows that repeat a (doc_id, text) are one
document, rows of one doc_id and different texts are several; rows with a null doc_id get a null component_id (unless a
component mate has an id) and kept = false. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.llm import _text as X
from voxmap.llm._util import Members, components, cut, forget, table
from voxmap.llm.op3_lines import KEY, _join, _key

RING_BITS = 20
BANDS, ROWS = 32, 4
PIVOTS = 3
HEAVY = 500_000
SKETCH = 0.6
_WIN: dict[int, np.ndarray] = {}


def _pi(k: int) -> np.ndarray:
    """Row x holds pi at places x .. x+k-1 of the ring: coordinate j of place x is pi[(x + j) mod 2^RING_BITS]."""
    if k not in _WIN:
        pi = np.random.default_rng(7).permutation(1 << RING_BITS).astype(np.uint32)
        _WIN[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _WIN[k]


def shingle_sets(col: pa.Array, width: int):
    """Yields (row, sorted distinct 64-bit shingle hashes) for each row of a string column."""
    for lo, hi, buf, off in X.text_chunks(col):
        starts, ends, words = X.word_spans(buf, off)
        h = X.hash_spans(buf, starts, ends, X.BYTE_LOWER)
        with np.errstate(over="ignore"):
            mul = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64)) for j in range(width)]
            full = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
            for j in range(width):
                full += h[j : j + len(full)] * mul[j]
            full = X.mix(full)
            for r in range(hi - lo):
                a, b = words[r], words[r + 1]
                if b - a >= width:
                    yield lo + r, np.unique(full[a : b - width + 1])
                elif b > a:
                    part = np.zeros(1, dtype=np.uint64)
                    for j in range(b - a):
                        part += h[a + j : a + j + 1] * mul[j]
                    yield lo + r, X.mix(part + np.uint64((b - a) * 2 + 1))
                else:
                    yield lo + r, np.zeros(0, dtype=np.uint64)


def signature(places: np.ndarray, k: int) -> np.ndarray:
    pi, out = _pi(k), None
    for a in range(0, len(places), 4096):
        m = pi[places[a : a + 4096]].min(axis=0)
        out = m if out is None else np.minimum(out, m)
    return out


def _sign(width: int, bands: int, rows: int):
    k = bands * rows

    def run(batches):
        with np.errstate(over="ignore"):
            mul = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 2**64) for j in range(rows)], dtype=np.uint64)
            salt = X.mix(np.arange(1, bands + 1, dtype=np.uint64))
            for batch in batches:
                n = batch.num_rows
                size, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                keys, sketch = [], [None] * n
                for r, u in shingle_sets(batch.column(3), width):
                    size[r] = len(u)
                    if len(u):
                        d = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                        s1[r], s2[r] = np.frombuffer(d, np.int64)
                        sig = signature((u >> np.uint64(64 - RING_BITS)).astype(np.int64), k).astype(np.uint64)
                        sketch[r] = X.mix(sig).astype(np.uint8).tobytes()
                        sig = sig.reshape(bands, rows)
                        keys.append(X.mix((sig * mul).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), pa.array(s1), pa.array(s2), X.lists(np.where(size > 0, bands, 0), flat, pa.int64()), pa.array(sketch, pa.binary())], [*KEY, "n_shingles", "s1", "s2", "keys", "sketch"])

    return run


def _emit_sets(width: int):
    """(id, p, chunk, role, text) -> (id, p, chunk, role, set bytes)."""

    def run(batches):
        for batch in batches:
            sets = [None] * batch.num_rows
            for r, u in shingle_sets(batch.column(4), width):
                sets[r] = u.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["id", "p", "chunk", "role", "set"])

    return run


def _compare(batches):
    """Rows sorted by (p, chunk, role descending): the pivot's set comes first, then each member's; one pivot is held."""
    at, pivot = None, None
    for batch in batches:
        ids, ps, ch, role = (np.asarray(batch.column(i)) for i in range(4))
        sets, a, b, both, either = batch.column(4), [], [], [], []
        for r in range(batch.num_rows):
            u = np.frombuffer(sets[r].as_buffer(), np.uint64)
            if role[r] == 1:
                at, pivot = (ps[r], ch[r]), u.copy()
            elif at == (ps[r], ch[r]):
                small, large = (u, pivot) if len(u) <= len(pivot) else (pivot, u)
                i = np.searchsorted(large, small)
                i[i == len(large)] = 0
                n = int((large[i] == small).sum())
                a.append(ids[r])
                b.append(ps[r])
                both.append(n)
                either.append(len(u) + len(pivot) - n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, both, either)], ["a", "b", "both", "either"])


def _alike(batches):
    """(x, p, sketch of x, sketch of p) -> the pairs (x, p) whose sketches agree in more than SKETCH of the places."""
    for b in batches:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            ok = (one == two).mean(axis=1) >= SKETCH
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], ["x", "p"])


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, p) that the sketches(rep, sketch) do not rule out."""
    two = pairs.hint("merge").join(sketches.select(F.col("rep").alias("x"), F.col("sketch").alias("sx")).hint("merge"), "x").join(sketches.select(F.col("rep").alias("p"), F.col("sketch").alias("sp")).hint("merge"), "p")
    return two.select("x", "p", "sx", "sp").mapInArrow(_alike, "x long, p long")


def _texts_of(texts: DataFrame, homes: DataFrame) -> DataFrame:
    """The columns of homes(d, t1, t2, ..) with the text of that key in texts(d, t1, t2, text); repeated rows count once.

    homes is a written table.
    """
    own = texts.where(Members(homes.select(*KEY).distinct(), *KEY).has(*KEY))
    one = own.groupBy(*KEY).agg(F.first("text").alias("text"))
    return _join(homes.hint("merge"), one, KEY)


def compare(texts: DataFrame, homes: DataFrame, pairs: DataFrame, width: int, per_chunk: int = 64) -> DataFrame:
    """The sizes of intersection and union of the full sets of each pair (x, p): (a, b, both, either).

    pairs is a written table; homes(id, d, t1, t2) tells where an id's text is. Members of a pivot with many are spread
    over chunks; each chunk gets one copy of the pivot's set.
    """
    n = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    with_chunk = pairs.hint("merge").join(n.hint("merge"), "p").select("x", "p", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / per_chunk)).cast("int").alias("chunk"))
    need = with_chunk.select(F.col("x").alias("id"), "p", "chunk", F.lit(0).alias("role")).unionByName(with_chunk.select(F.col("p").alias("id"), "p", "chunk", F.lit(1).alias("role")).distinct())
    need = cut(need.hint("merge").join(homes.hint("merge"), "id"), "need")
    sets = _texts_of(texts, need).select("id", "p", "chunk", "role", "text").mapInArrow(_emit_sets(width), "id long, p long, chunk int, role int, set binary")
    return sets.repartition("p", "chunk").sortWithinPartitions("p", "chunk", F.desc("role")).mapInArrow(_compare, "a long, b long, both long, either long")


def _tokens(width: int):
    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for r, u in shingle_sets(batch.column(1), width):
                rows.append(np.full(len(u), r))
                parts.append(u.view(np.int64))
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))], ["rep", "token"])

    return run


def sharing_prefixes(texts: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """All pairs (x, p) of docs(rep, size, comp) in different components that can reach the threshold, by prefix filter.

    Shingles are ordered by hash, those in very many documents last (any order that all sets share is exact). These are
    so few that they fit a broadcast: HEAVY at most. A token's most frequent component is only probed by the members of
    others, so one huge component costs rows in proportion to its size.
    """
    tokens = cut(texts.mapInArrow(_tokens(width), "rep long, token long"), "tokens")
    least = max(32, -(-tokens.count() // HEAVY))
    heavy = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    ranks = tokens.join(F.broadcast(heavy), "token", "left").hint("merge").join(docs.hint("merge"), "rep")
    ranks = ranks.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(0)), "token")))
    # a set of n needs ceil(t n) common shingles at least, so one of its first n - ceil(t n) + 1 is common
    prefix = ranks.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).select("rep", "size", "comp", "token", "r")
    prefix = cut(prefix, "prefixes")
    main = prefix.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", F.col("m.comp").alias("main"))
    x = prefix.join(main, "token").where("comp <> main").alias("x")
    y = prefix.alias("y")
    # where the first common token stands at r and q, no more than 1 + min(n - r, m - q) shingles are common
    enough = (100 + percent) * (1 + F.least(F.col("x.size") - F.col("x.r"), F.col("y.size") - F.col("y.r"))) >= percent * (F.col("x.size") + F.col("y.size"))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (percent * F.greatest("x.size", "y.size") <= 100 * F.least("x.size", "y.size")) & enough
    return x.join(y, on).select(F.greatest("x.rep", "y.rep").alias("x"), F.least("x.rep", "y.rep").alias("p")).distinct()


def join_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(node, comp) with the further links(a, b): only components that a link joins are looked at again."""
    edges = links
    for end in ("a", "b"):
        edges = edges.hint("merge").join(comp.select(F.col("node").alias(end), F.col("comp").alias("_c")).hint("merge"), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    up = cut(components(edges), "joined")
    old = comp.hint("merge").join(up.select(F.col("node").alias("comp"), F.col("comp").alias("_c")).hint("merge"), "comp", "left").select("node", F.coalesce("_c", "comp").alias("comp"))
    return old.union(up.hint("merge").join(comp.select("node").hint("merge"), "node", "left_anti").select("node", "comp"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """d, t1, t2 (the key of a row), n_shingles, component_id and first for each row of docs(doc_id, text).

    component_id is the smallest doc_id of the component; first: this row's key is the component's smallest.

    A pair at exactly the threshold s misses all bands with probability (1 - s^rows)^bands: 5e-8 at 0.8, less above.
    """
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select(*_key(F.col("doc_id"), F.col("text")), "text")
    signed = cut(texts.mapInArrow(_sign(width, bands, rows), "d long, t1 long, t2 long, n_shingles long, s1 long, s2 long, keys array<long>, sketch binary"), "minhash")
    place = F.struct(F.col("d").isNull().alias("o"), *KEY)
    # a class: all documents with one shingle set; the smallest key stands for it
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct(place.alias("at"), "keys", "sketch", "n_shingles")).alias("m"))
    classes = cut(classes.select("s1", "s2", F.monotonically_increasing_id().alias("rep"), *[F.col(f"m.at.{c}").alias(c) for c in KEY], "m.keys", "m.sketch", F.col("m.n_shingles").alias("size")), "classes")
    homes = classes.select(F.col("rep").alias("id"), *KEY)
    member = classes.select(F.explode("keys").alias("key"), "rep", "size")
    twice = cut(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n"), "buckets")
    member = member.where(Members(twice, "key").has("key")).hint("merge").join(twice.hint("merge"), "key")
    # o: the order of the classes; one that shares its buckets with many comes first
    member = cut(member.withColumn("o", F.struct((-F.sum("n").over(Window.partitionBy("rep"))).alias("w"), "rep")), "members")
    sketches = classes.select("rep", "sketch")
    fits = lambda x, y: percent * F.greatest(x, y) <= 100 * F.least(x, y)
    linked = f"100 * both >= {percent} * either"
    def met(members: DataFrame, pivots: DataFrame) -> DataFrame:
        other = (F.col("q.o") < F.col("o")) & (F.col("comp") != F.col("q.comp"))
        return members.hint("merge").join(pivots.hint("merge"), "key").where(other & fits(F.col("size"), F.col("q.size"))).select(F.col("rep").alias("x"), F.col("q.rep").alias("p"), F.col("q.o.w").alias("w"))

    def first(members: DataFrame) -> DataFrame:
        return cut(members.groupBy("key").agg(F.min(F.struct("o", "rep", "size", "comp")).alias("q")), "pivots")

    # first of all a class meets one pivot, of most of its buckets, so a group of near copies costs a pair a member
    alone = member.withColumn("comp", F.col("rep"))
    best = met(alone, first(alone)).groupBy("x", "p", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("x").agg(F.min(F.struct((-F.col("n")).alias("n"), "w", "p")).alias("b")).select("x", "b.p")
    sims = cut(compare(texts, homes, cut(alike(best, sketches), "pairs"), width), "sims")
    comp = cut(components(sims.where(linked).select("a", "b")), "comp")

    def still_open(members: DataFrame) -> DataFrame:
        """members(key, n, rep, size) of the buckets that hold several components, with theirs."""
        lab = members.hint("merge").join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("key", "n", "rep", "size", "o", F.coalesce("comp", "rep").alias("comp"))
        keys = lab.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return lab.hint("merge").join(keys.hint("merge"), "key", "left_semi")

    # then the members of such buckets meet the PIVOTS first that are in other components
    some = cut(still_open(member), "open")
    stars, pairs = [], None
    for _ in range(PIVOTS):
        over = some if not stars else some.hint("merge").join(stars[-1].select("key", F.col("q.o").alias("_after")).hint("merge"), "key").where("o > _after").drop("_after")
        stars.append(first(over))
        pairs = met(some, stars[-1]) if pairs is None else pairs.union(met(some, stars[-1]))
    pairs = cut(alike(pairs.select("x", "p").distinct().hint("merge").join(sims.select(F.col("a").alias("x"), F.col("b").alias("p")).hint("merge"), ["x", "p"], "left_anti"), sketches), "pairs")
    if not pairs.isEmpty():
        more = cut(compare(texts, homes, pairs, width), "sims")
        comp = cut(join_components(comp, more.where(linked).select("a", "b")), "comp")
        sims = sims.unionByName(more)
    # what the stars can't see: members of one large bucket that are in different components still
    still = cut(still_open(some.drop("comp").where(F.col("n") > PIVOTS + 1)).select("rep", "size", "comp").distinct(), "open")
    if not still.isEmpty():
        at = cut(still.select(F.col("rep").alias("id")).hint("merge").join(homes.hint("merge"), "id"), "homes")
        own = _texts_of(texts, at).select("id", "text")
        more = cut(alike(sharing_prefixes(own, still, width, percent), sketches).hint("merge").join(sims.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("p")).hint("merge"), ["x", "p"], "left_anti"), "more")
        if not more.isEmpty():
            comp = cut(join_components(comp, compare(texts, homes, more, width).where(linked).select("a", "b")), "comp")
    forget(member)
    forget(some)
    of = classes.select("s1", "s2", "rep", *KEY).hint("merge").join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    top = of.groupBy("comp").agg(F.min(place).alias("top"))
    of = of.select("s1", "s2", "comp").hint("merge").join(top.hint("merge"), "comp").drop("comp")
    out = signed.select(*KEY, "n_shingles", "s1", "s2").hint("merge").join(of.hint("merge"), ["s1", "s2"], "left")
    alone = F.col("top").isNull()
    return out.select(*KEY, "n_shingles", F.when(alone, F.col("d")).otherwise(F.col("top.d")).alias("component_id"), (alone | place.eqNullSafe(F.col("top"))).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    g = groups(docs, width, percent)
    return g.select(F.col("d").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("d") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on 2-word shingles at Jaccard 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents where text is not null),
shingles as (select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) s from w where len(w) > 0),
sizes as (select doc_id, count(*) n from shingles group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id id, doc_id c from documents union select l.b, r.c from reach r join links l on l.a = r.id)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept from documents d
join (select id, min(c) component_id from reach group by id) on id = d.doc_id left join sizes s on s.doc_id = d.doc_id"""
