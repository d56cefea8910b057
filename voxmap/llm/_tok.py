"""Whole-text encoding with the tokenizers library, each distinct piece of a worker's texts encoded once.

A text is cut only where its tokenizer always begins a new pre-token: at ASCII white space, and between an ASCII letter
and one of . , ! ? ; : after it. So the ids of the pieces, in order, are the ids of the text. Pieces are found and
looked up by 64-bit hash in numpy; the library encodes those not seen before. The memory of pieces is emptied when it
holds MEMO pieces: a bound on memory, not on results.

With `added`, an added token that stands in a text ('<|endoftext|>') has its own id, as in a plain library call, and the
text is encoded in one piece; without, it is ordinary text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from voxmap.llm import _text as X

MEMO = 1_000_000
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".,!?;:"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: white space, or taken for it by some library, beyond \x20 and \x09-\x0D: such texts are encoded in one piece
_ODD = [bytes([c]) for c in range(0x1C, 0x20)] + [s.encode() for s in "\x85\xa0   　"] + [b"\xe2\x80"]
_CODERS: dict[tuple[str, bool, bool], Coder] = {}


def _marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The distinct places, each from 0 to n, in order: marked byte by byte, which costs far less than to sort or hash them."""
    mark = np.zeros(n + 1, dtype=bool)
    for p in places:
        mark[p] = True
    return np.flatnonzero(mark)


class Coder:
    def __init__(self, path: str, spaced: bool, added: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        #: in lower case, as the memory of pieces may be
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()] if added else []
        self.spaced = spaced
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and the pieces before each row."""
        starts, ends, _ = X.word_spans(buf, off)
        n = len(buf)
        i = np.flatnonzero(_END[buf[1:]] & _LETTER[buf[:-1]]) + 1 if n else np.zeros(0, np.int64)
        if not self.spaced:
            # at a row's start, i is among both already
            s, e = _marked(n, starts, i), _marked(n, ends, i)
            return s, e, np.searchsorted(s, off)
        row = np.searchsorted(off, starts, "right") - 1
        prev = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        gap = starts - np.maximum(prev, off[row])
        joined = (gap > 0) & (buf[np.maximum(starts - 1, 0)] == 0x20)
        cuts = _marked(n, off[:-1][off[1:] > off[:-1]], starts - joined, ends[ends < n], (starts - 1)[~joined & (gap >= 2)], i)
        return cuts, np.concatenate([cuts[1:], [n]]) if len(cuts) else cuts, np.searchsorted(cuts, off)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.library(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        flat = np.fromiter((x for one in ids for x in one), np.uint32, total)
        self.flat[self.used : self.used + total] = flat
        start = self.used + np.cumsum(count) - count
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.count, at, count)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, offsets of the rows in them)."""
        starts, ends, first = self.pieces(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        h = X.hash_spans(buf, starts, ends, X.BYTE if self.spaced else X.BYTE_LOWER)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > MEMO:
            self.clear()
        k = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = k < len(self.keys)
        known[inside] = self.keys[k[inside]] == uniq[inside]
        if not known.all():
            raw, miss = buf.tobytes(), at[~known]
            self.learn(uniq[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)])
            k = np.searchsorted(self.keys, uniq)
        s, c = self.start[k][inv], self.count[k][inv]
        to = np.zeros(len(c) + 1, np.int64)
        np.cumsum(c, out=to[1:])
        return self.flat[np.repeat(s - to[:-1], c) + np.arange(to[-1])], to[first]


def coder(path: str, spaced: bool, added: bool) -> Coder:
    if (path, spaced, added) not in _CODERS:
        _CODERS[path, spaced, added] = Coder(path, spaced, added)
    return _CODERS[path, spaced, added]


def encoded_rows(col: pa.Array, path: str, spaced: bool, end_id: int, added: bool = False, chunk: int = 1 << 20):
    """(row, uint32 ids of the whole text and end_id) for each row of a string column; null is empty.

    chunk: about the bytes of whole texts that are worked on at once.
    """
    c, end = coder(path, spaced, added), np.array([end_id], np.uint32)
    for lo, _, buf, off in X.text_chunks(col, chunk):
        raw = buf.tobytes()
        low = raw.lower() if c.added else b""
        whole = [(raw, _ODD)] if spaced and any(o in raw for o in _ODD) else []
        whole += [(low, c.added)] if any(t in low for t in c.added) else []
        odd = [r for r in range(len(off) - 1) if any(o in text[off[r] : off[r + 1]] for text, marks in whole for o in marks)] if whole else []
        alone = {r: np.array(c.library([raw[off[r] : off[r + 1]].decode("utf-8", "replace")])[0], np.uint32) for r in odd}
        ids, at = c.encode(buf, off)
        for r in range(len(off) - 1):
            yield lo + r, np.concatenate([alone[r] if r in alone else ids[at[r] : at[r + 1]], end])
