"""Vectorised text primitives over Arrow string columns: whole texts, no copies into Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: \x20 and \x09-\x0D
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_P = U64(0x9E3779B97F4A7C55)
_PINV = U64(pow(int(_P), -1, 2**64))
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([[U64(1)], np.full(n, _P)]), dtype=np.uint64)
            _inv = np.cumprod(np.concatenate([[U64(1)], np.full(n, _PINV)]), dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of each row in them) of a string column, about `limit` bytes each.

    A row is never cut; null counts as empty. A longer text makes a chunk of its own.
    """
    n = len(col)
    if not n:
        return
    if pa.types.is_dictionary(col.type):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, never across rows; and the words before each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    cut = off[off < n]
    before[cut] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each span's bytes (a polynomial over Z/2^64 from prefix sums, then mixed)."""
    n = len(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    pw, inv = _powers(n + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte[buf] * pw[:n], out=c[1:])
        return mix((c[ends] - c[starts]) * inv[starts] ^ (ends - starts).astype(np.uint64))


def validity(col: pa.Array) -> np.ndarray:
    return np.asarray(col.is_valid())


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))
