"""Token-id files: every document's ids compressed on their own with one shared zstandard dictionary.

A folder holds `dictionary.zdict`, one shard file per range of documents and `manifest.json`. A shard file is

    magic (8 bytes) | frames, one zstandard frame per document | index | JSON header | header length (8 bytes)

The index has, per document, whether doc_id is set, doc_id, where the frame begins, and the number of ids, so a short
document is read with one seek. The header names the SHA-256 of the dictionary; a reader refuses another dictionary.
The dictionary is trained on the serialized ids of a bounded sample of documents (SAMPLE documents on the
average, those with a small hash, of SAMPLE_IDS ids at most), the files hold all ids of all documents.

Documents are dealt by ranges of (doc_id, crc32 of the text), so equal doc_ids do not meet in one task. A shard is
written under a name of its own for each attempt; only those in the manifest count, so a task that ran twice does no
harm. Defined results: null text is empty (its end id only); rows with a null doc_id come first; other columns ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm._tok import encoded_rows
from voxmap.llm._util import empty, new_path, table

MAGIC = b"VXIDS01\n"
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 2_048, 112_640


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves as raw content."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, dictionary: bytes):
        self.uri, self.sha = uri, hashlib.sha256(dictionary).hexdigest()
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        f, path = open_dir(uri)
        self.out = f.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.rows = len(MAGIC), []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        z = self.zip.compress(ids.astype("<u4").tobytes())
        self.out.write(z)
        self.rows.append((doc_id is not None, doc_id or 0, self.at, len(ids)))
        self.at += len(z)

    def close(self) -> tuple[int, int]:
        cols = list(zip(*self.rows, strict=True))
        index = b"".join(np.array(c, k).tobytes() for c, k in zip(cols, ("u1", "<i8", "<u8", "<u8"), strict=True))
        head = json.dumps({"dictionary": self.sha, "docs": len(self.rows), "index": self.at, "ids": "<u4"}).encode()
        self.out.write(index + head + struct.pack("<Q", len(head)))
        self.out.close()
        return len(self.rows), int(sum(cols[3]))


class ShardReader:
    """Random and sequential access to one shard file."""

    def __init__(self, uri: str, dictionary: bytes):
        f, path = open_dir(uri)
        self.f = f.open_input_file(path)
        size = self.f.size()
        n = struct.unpack("<Q", self.f.read_at(8, size - 8))[0]
        self.head = json.loads(self.f.read_at(n, size - 8 - n))
        if self.f.read_at(8, 0) != MAGIC or self.head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        d, at = self.head["docs"], self.head["index"]
        raw = self.f.read_at(d * 25, at)
        self.valid = np.frombuffer(raw, "u1", d, 0).astype(bool)
        self.doc_id, self.start, self.count = (np.frombuffer(raw, k, d, d + 8 * d * i) for i, k in enumerate(("<i8", "<u8", "<u8")))
        self.stop = np.append(self.start[1:], at).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        z = self.f.read_at(int(self.stop[k]) - int(self.start[k]), int(self.start[k]))
        ids = np.frombuffer(self.unzip.decompress(z, max_output_size=int(self.count[k]) * 4), "<u4")
        if len(ids) != self.count[k]:
            raise ValueError(f"document {k} of the shard is damaged")
        return ids


def _sample_ids(path: str, end_id: int, added: bool):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([i[:SAMPLE_IDS].astype("<u4").tobytes() for _, i in encoded_rows(b.column(0), path, True, end_id, added)], pa.binary())], ["ids"])

    return run


def _write(uri: str, path: str, dictionary: bytes, end_id: int, added: bool):
    def run(batches):
        w, first = None, None
        for b in batches:
            ids, crc = b.column(0).to_pylist(), b.column(2)
            for r, one in encoded_rows(b.column(1), path, True, end_id, added):
                if w is None:
                    name = f"{uri}/shard-{uuid.uuid4().hex}.vxids"
                    w, first = ShardWriter(name, dictionary), (ids[r], crc[r].as_py())
                w.add(ids[r], one)
        if w is not None:
            docs, total = w.close()
            yield pa.RecordBatch.from_pydict({"path": [w.uri], "first_id": pa.array([first[0]], pa.int64()), "first_crc": pa.array([first[1]], pa.int64()), "docs": [docs], "ids": [total]})

    return run


def _read(dictionary: bytes):
    def run(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = ShardReader(uri, dictionary)
                start = base + np.cumsum(s.count.astype(np.int64)) - s.count.astype(np.int64)
                for a in range(0, len(s.count), 5_000):
                    z = min(a + 5_000, len(s.count))
                    crc = np.array([zlib.crc32(s.ids(k).tobytes()) for k in range(a, z)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_id[a:z], mask=~s.valid[a:z]), pa.array(start[a:z]), pa.array(s.count[a:z].astype(np.int64)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0, added: bool = False) -> list[dict]:
    """Write all documents' ids under uri in ascending doc_id order; returns the manifest (one entry per shard file)."""
    f, path = open_dir(uri)
    f.create_dir(path, recursive=True)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    # the texts with a small hash, SAMPLE of them on the average: they are picked where they are
    bound = ((1 << 63) - 1) * SAMPLE // max(SAMPLE, base.count())
    few = base.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= bound).select("text")
    samples = [r.ids for r in few.mapInArrow(_sample_ids(tokenizer, end_id, added), "ids binary").toLocalIterator()]
    dictionary = train_dictionary([bytes(s) for s in samples])
    with f.open_output_stream(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)
    dealt = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("crc")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc")
    made = dealt.mapInArrow(_write(uri, tokenizer, dictionary, end_id, added), "path string, first_id long, first_crc long, docs long, ids long").collect()  # a row per file
    made.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_crc))
    start, manifest = 0, []
    for r in made:
        manifest.append({"path": r.path, "start": start, "docs": r.docs, "ids": r.ids})
        start += r.ids
    with f.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "shards": manifest}).encode())
    return manifest


def load_manifest(uri: str) -> tuple[list[dict], bytes]:
    f, path = open_dir(uri)
    m = json.loads(f.open_input_file(f"{path}/manifest.json").read())
    d = f.open_input_file(f"{path}/dictionary.zdict").read()
    if hashlib.sha256(d).hexdigest() != m["dictionary"]:
        raise ValueError("the dictionary is not the one of the manifest")
    return m["shards"], d


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards, dictionary = load_manifest(uri)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return empty(spark, ddl)
    rows = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long").repartition(len(shards))
    return rows.mapInArrow(_read(dictionary), ddl)


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level BPE ids written to token files and read back from them."""
    uri = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), uri, tokenizer_path("byte_bpe_50k.json"), added=True)
    return read_token_files(spark, uri)
