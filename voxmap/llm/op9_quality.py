"""Quality classifier: random-indexing word vectors, a two-layer network, temperature-calibrated probabilities.

Random indexing: every token bucket has a sparse ternary index vector made from its number alone; its word vector is
the sum of the index vectors of the tokens within WINDOW places of its occurrences, over all texts of the corpus. A
document is the mean of its tokens' unit word vectors, with the shares of capital, repeated, punctuation and digit
tokens and its length beside them. The network (one hidden layer) is trained in numpy on at most TRAIN labelled rows,
those with the smallest hash of their id; a fifth of them sets the temperature.

The sums are made where the rows are, added up by bucket, and only VOCAB x DIM numbers reach the driver; the corpus
size does not change that.

Defined results: null and empty texts have the zero vector and are scored like others; without labels the score is 0.5,
with one class only it is that class; a label row that is null or matches no document is not used; repeated rows are
scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm import _text as X
from voxmap.llm._util import small_batches, table
from voxmap.llm.op8_language import remainder

VOCAB, DIM, WINDOW, TRAIN, HIDDEN = 1 << 14, 48, 2, 20_000, 32
EXTRA = 6
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[X.SPACE] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def tokens(buf: np.ndarray, off: np.ndarray):
    """Runs of letters, of digits and of other signs: (bucket, kind, capitals only, tokens before each row, length)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool), np.zeros(len(off), np.int64), z
    kind = _KIND[buf]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[off[off < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    k = kind[starts]
    starts, ends, k = starts[k > 0], ends[k > 0], k[k > 0]
    h = X.hash_spans(buf, starts, ends, X.BYTE_LOWER)
    up = np.zeros(n + 1, np.int32)
    np.cumsum(_UPPER[buf], out=up[1:])
    length = ends - starts
    caps = (up[ends] - up[starts] == length) & (length > 1)
    return (h % np.uint64(VOCAB)).astype(np.int64), k, caps, np.searchsorted(starts, off), length


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places of the +1 and of the -1 in each bucket's index vector."""
    r = np.random.default_rng(11)
    plus = r.integers(0, DIM, VOCAB)
    return plus, (plus + r.integers(1, DIM, VOCAB)) % DIM


def _accumulate(batches):
    plus, minus = index_vectors()
    acc = np.zeros(VOCAB * DIM)
    for b in batches:
        for _, _, buf, off in X.text_chunks(b.column(0)):
            w, _, _, first, _ = tokens(buf, off)
            row = np.searchsorted(first, np.arange(len(w)), "right")
            for s in range(1, WINDOW + 1):
                same = row[s:] == row[:-s]
                a, c = w[:-s][same], w[s:][same]
                for x, y in ((a, c), (c, a)):
                    acc += np.bincount(x * DIM + plus[y], minlength=VOCAB * DIM)
                    acc -= np.bincount(x * DIM + minus[y], minlength=VOCAB * DIM)
    m = acc.reshape(VOCAB, DIM).astype(np.float32)
    used = np.flatnonzero(m.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([v.tobytes() for v in m[used]], pa.binary())], ["bucket", "v"])


def _add(batches):
    m = np.zeros((VOCAB, DIM), np.float64)
    for b in batches:
        if b.num_rows:
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, DIM)
            np.add.at(m, np.asarray(b.column(0)), v)
    used = np.flatnonzero(m.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([v.tobytes() for v in m[used].astype(np.float32)], pa.binary())], ["bucket", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (VOCAB x DIM) over all texts of docs(text)."""
    parts = docs.select("text").mapInArrow(_accumulate, "bucket int, v binary")
    with small_batches(docs.sparkSession):
        rows = parts.repartition("bucket").mapInArrow(_add, "bucket int, v binary").collect()  # VOCAB rows at most
    m = np.zeros((VOCAB, DIM), np.float32)
    for r in rows:
        m[r.bucket] = np.frombuffer(r.v, np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def features(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(col), DIM + EXTRA), np.float32)
    for lo, hi, buf, off in X.text_chunks(col):
        w, kind, caps, first, length = tokens(buf, off)
        n = np.diff(first)
        some = np.flatnonzero(n > 0)
        if not len(some):
            continue
        at, per = first[:-1][some], n[some].astype(np.float32)[:, None]
        out[lo + some, :DIM] = np.add.reduceat(vectors[w], at, axis=0) / per
        again = np.zeros(len(w), np.float32)
        again[1:] = w[1:] == w[:-1]
        again[at] = 0
        cols = np.column_stack([caps, again, kind == 3, kind == 2, np.minimum(length, 30) / 10]).astype(np.float32)
        out[lo + some, DIM : DIM + 5] = np.add.reduceat(cols, at, axis=0) / per
        out[lo + some, DIM + 5] = np.log1p(n[some])
    return out


class Network:
    """inputs -> HIDDEN tanh -> one logistic output, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, rate: float = 0.01):
        self.constant = 0.5 if not len(y) else float(y[0]) if (y == y[0]).all() else None
        self.temperature = 1.0
        if self.constant is not None:
            return
        r = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        held = np.arange(len(y)) % 5 == 4
        z, t = self.scale(x[~held]), y[~held].astype(np.float64)
        d = z.shape[1]
        p = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(epochs):
            order = r.permutation(len(t))
            for a in range(0, len(t), 128):
                i = order[a : a + 128]
                h = np.tanh(z[i] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - t[i]) / len(i)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
                step += 1
                for q, gr, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (gr - mm)
                    vv += 0.001 * (gr * gr - vv)
                    q -= rate * 0.97**epoch * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.p = p
        if held.any():
            logit, t = self.logits(x[held]), y[held]
            loss = lambda c: np.mean(np.logaddexp(0, np.where(t == 1, -1, 1) * logit / c))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8).astype(np.float64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scale(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _features(vectors):
    def run(batches):
        for b in batches:
            f = features(b.column(1), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in f], pa.binary())], ["quality", "f"])

    return run


def _scores(vectors, net: Network, first: int):
    def run(batches):
        for b in batches:
            s = net.score(features(b.column(0), vectors.value))
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(s)], [*b.schema.names[first:], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN):
    """(broadcast word vectors, network) from all texts of docs(doc_id, text) and rows of labels(doc_id, quality)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # VOCAB x DIM numbers
    some = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64("doc_id", F.lit(9))).orderBy("h", "doc_id", "quality").limit(train)
    with small_batches(spark):
        rows = docs.join(F.broadcast(some), "doc_id").select("quality", "text", "h").select("quality", "text").mapInArrow(_features(vectors), "quality int, f binary").collect()  # `train` rows at most
    rows.sort(key=lambda r: (bytes(r.f), r.quality))
    order = np.random.default_rng(1).permutation(len(rows))
    x = np.array([np.frombuffer(rows[i].f, np.float32) for i in order]) if rows else np.zeros((0, DIM + EXTRA))
    return vectors, Network(x, np.array([int(rows[i].quality == 1) for i in order]))


def score(docs: DataFrame, model, keep_text: bool = False) -> DataFrame:
    """docs(text and others) with `score` in place of text, or beside it."""
    vectors, net = model
    cols = ["text", *[c for c in docs.columns if c not in ("text", "score")]]
    out = cols if keep_text else cols[1:]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return docs.select(*cols).mapInArrow(_scores(vectors, net, 0 if keep_text else 1), f"{ddl}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels with remainder 0 mod 5 are held out."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(d, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return score(d.withColumn("held_out", remainder("doc_id", 5) == 0), model).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
