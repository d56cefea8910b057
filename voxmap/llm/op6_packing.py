"""Best-fit packing with large-item matching.

A plan is made on the histogram of piece lengths (one row per length, so no more rows than the capacity), and then
applied to all pieces by their rank within their length. Pieces above a third of the capacity are large: at most two
share a sequence; greedy matching, from the longest down, pairs each with the longest large piece that still fits.
Pieces of a third or less go, from the longest down, where the remaining gap is smallest (best fit), and open
sequences of their own when no gap is left.

The driver holds the histogram and the plan, never a piece. Pieces of one very common length are ranked in blocks.
Defined results: null or empty text is one piece (the end id); repeated rows are packed as often as they occur; rows
with a null doc_id are packed too; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm._tok import encoded_rows
from voxmap.llm._util import cut, empty, ranked, table
from voxmap.llm.op10_tokenfile import tokenizer_path

#: bytes of texts encoded at once: 97 MB of a worker at the peak, 144 MB with 1 MB, for 15 % more CPU
CHUNK = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int, added: bool):
    def run(batches):
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in encoded_rows(b.column(1), path, False, end_id, added, CHUNK):
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(ids), capacity):
                    row.append(r)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(min(capacity, len(ids) - k))
                    crc.append(zlib.crc32(raw[4 * k : 4 * (k + capacity)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(slots, number of sequences) for {length: pieces}.

    A slot (length, lo, n, k, first sequence, offset) takes the n pieces of that length from rank lo on, k to a
    sequence, into sequences from `first` on, beginning at `offset` in each.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a length is out of range")
    used: dict[int, int] = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)
    order: list[int] = []
    total = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, k: int, first: int, offset: int) -> None:
        slots.append((length, used[length], n, k, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect_left(large, capacity - a + 1) - 1
            while i >= 0 and not (left[large[i]] and large[i] <= a):
                i -= 1
            if i < 0 or (large[i] == a and left[a] == 1):
                # alone, unless a shorter one is there
                i = next((j for j in range(min(i, len(large) - 1), -1, -1) if left[large[j]] and large[j] < a), -1)
            if i < 0:
                n = left[a]
                put(a, n, 1, total, 0)
                free(capacity - a, total, n)
                total += n
                continue
            b = large[i]
            n = left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, 1, total, 0)
            put(b, n, 1, total, a)
            free(capacity - a - b, total, n)
            total += n
    for a in sorted((x for x in left if left[x]), reverse=True):
        while left[a]:
            i = bisect_left(order, a)
            if i == len(order):
                per = capacity // a
                n = -(-left[a] // per)
                free(capacity, total, n)
                total += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            k = gap // a
            whole = min(n, left[a] // k)
            if whole:
                put(a, whole * k, k, first, capacity - gap)
                free(gap - k * a, first, whole)
            if whole < n:
                rest = left[a]
                if rest:  # fewer than k are left: one sequence takes them
                    put(a, rest, rest, first + whole, capacity - gap)
                    free(gap - rest * a, first + whole, 1)
                free(gap, first + whole + bool(rest), n - whole - bool(rest))
    return slots, total


def cut_and_encode(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, added: bool = False) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_pieces(tokenizer, end_id, capacity, added), PIECES)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32), read from a written table."""
    spark = pieces.sparkSession
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not hist:
        return empty(spark, PIECES + ", sequence_id long, offset long")
    slots, _ = plan(hist, capacity)
    by: dict[int, list] = {}
    for length, lo, n, k, first, offset in slots:
        by.setdefault(length, []).append((lo, k, first, offset))
    plan_df = spark.createDataFrame([(a, sorted(s)) for a, s in by.items()], "length long, slots array<struct<lo:long,k:long,first:long,at:long>>")
    r = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece", "ids_crc32"], sum(hist.values()))
    # at most `capacity` rows, one per length
    j = r.join(F.broadcast(plan_df), "length").withColumn("s", F.expr("element_at(filter(slots, x -> x.lo <= rank), -1)"))
    within = F.col("rank") - F.col("s.lo")
    return j.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.first") + F.expr("(rank - s.lo) div s.k")).cast("long").alias("sequence_id"),
        (F.col("s.at") + (within % F.col("s.k")) * F.col("length")).cast("long").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    return pack(cut(cut_and_encode(docs, tokenizer_path("word_bpe_49k.json"), added=True), "pieces"))
