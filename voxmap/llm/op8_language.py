"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent letter n-grams (1 to 3 letters, a blank at word ends) of a language's training
texts, by rank. A document's own most frequent n-grams are ranked the same way over the whole text, and the language
with the smallest out-of-place distance (sum of rank differences, PROFILE for an n-gram that a profile lacks) wins.

Training texts: all documents of a language up to `per_language`, and of a larger one those with a small hash,
`per_language` of them on the average; counts are added up where the rows are, only the profiles reach the driver.

Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing could be learned; equal
distances go to the language first in code point order; rows with a null doc_id are treated as doc_id ''; other columns
are ignored. score is 1 - distance / largest possible distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmap.llm._util import table

PROFILE, PER_LANGUAGE = 300, 4000
LANGUAGES = 10_000  # as many rows at most are broadcast
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        t = np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                t[c] = True
        _LETTERS.append(t)
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text (21 bits a letter, 0 for the blank at a word's end); empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ok = letters()[c]
    if not ok.any():
        return np.zeros(0, np.int64)
    c = np.where(ok, c, 0)
    c = np.concatenate([[0], c, [0]])
    keep = (c != 0) | np.concatenate([[True], c[:-1] != 0])
    c = c[keep]
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 0]
    return np.concatenate([c[c != 0], two, three])


def ranked_grams(text: str, k: int) -> np.ndarray:
    """The k most frequent n-grams, most frequent first; ties by code."""
    u, n = np.unique(grams(text), return_counts=True)
    return u[np.argsort(-n, kind="stable")[:k]]


def _count(batches):
    acc: dict[str, list] = {}

    def fold(parts):
        u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(u, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = acc.setdefault(lang, [])
            parts.append(np.unique(grams(text or ""), return_counts=True))
            if len(parts) > 200:
                acc[lang] = fold(parts)
    for lang, parts in acc.items():
        u, n = fold(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n)], ["lang", "code", "n"])


def learn(docs: DataFrame, profile: int = PROFILE, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """{language: codes by rank} from docs(doc_id, text, lang), rows with a lang and a text."""
    d = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(8)), 1))
    # the hash up to which a language's rows are taken, from their number: a row per language
    top = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    top = top.select("lang", F.when(F.col("n") <= per_language, F.lit((1 << 63) - 1)).otherwise(F.greatest("least", (F.lit(float(per_language) * 2.0**63) / F.col("n")).cast("long"))).alias("top"))
    side = F.broadcast(top) if top.count() <= LANGUAGES else top
    used = d.join(side, "lang").where("h <= top").select("lang", "text")
    counts = used.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "code", "r").collect(), key=lambda r: (r.lang, r.r)):  # `profile` rows a language
        out.setdefault(r.lang, []).append(r.code)
    return out


class Model:
    def __init__(self, profiles: dict[str, list[int]], k: int):
        self.names, self.k = sorted(profiles), k
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, n in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, profiles[n])] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked_grams(text, self.k) if text else []
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        r = self.rank[:, at]
        d = np.where(r < 0, self.k, np.minimum(np.abs(r - np.arange(len(own))), self.k)).sum(axis=1)
        i = int(np.argmin(d))
        return self.names[i], float(1 - d[i] / (self.k * len(own)))


def _predict(model):
    def run(batches):
        m = model.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def remainder(column: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def identify(docs: DataFrame, profiles: dict[str, list[int]], k: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs(doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast(Model(profiles, k))  # k codes a language
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those whose remainder mod 4 is not 2."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.withColumn("held_out", remainder("doc_id", 4) == 2)
    return identify(d, learn(d.where("not held_out")))
