import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxmap.llm import op6_packing as P6
from voxmap.llm import _text as X
from voxmap.llm import op10_tokenfile as P10
from voxmap.llm._tok import coder, encoded_rows
from voxmap.llm.op10_tokenfile import tokenizer_path

SF = "/root/testdata/sf0.01"
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def strange(n=300):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "É", "ß", "'s", "'", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!!", "1", "²", "…", "\xa0", " ", "\x85", "\x1d", "日本", "é", "́", "<|endoftext|>", "×", "\u0000", "I'll", "_", "😀", "İ", "Σ"]
    return [None, "", " ", "\n\n", " a", "a ", "a\n\n b", "a\n\nb", "x" * 50_000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize(("path", "spaced", "end"), [(BYTE, True, 0), (WORD, False, 1)])
def test_pieces_give_the_ids_of_the_text(path, spaced, end):
    texts = strange()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for r, ids in encoded_rows(pa.array(texts), path, spaced, end):
        assert ids.tolist() == [*tok.encode(texts[r] or "", add_special_tokens=False).ids, end], repr(texts[r])


@pytest.mark.parametrize(("path", "spaced", "end"), [(BYTE, True, 0), (WORD, False, 1)])
def test_added_tokens_as_in_a_plain_call(path, spaced, end):
    texts = [*strange(), "a<|endoftext|>b", "<|EndOfText|> <|startoftext|>", "x <|endoftext|>", "x <|EndOfText|>", "<|startoftext|>\xa0<|endoftext|>"]
    tok = Tokenizer.from_file(path)
    for r, ids in encoded_rows(pa.array(texts), path, spaced, end, added=True):
        assert ids.tolist() == [*tok.encode(texts[r] or "", add_special_tokens=False).ids, end], repr(texts[r])


def test_pieces_cost_little_beside_their_hashes():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 9))) for _ in range(160_000)]
    col = pa.array([" ".join(words[k : k + 500]) + "." for k in range(0, len(words), 500)])
    ((_, _, buf, off),) = X.text_chunks(col)
    c = coder(BYTE, True, True)

    def least(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    starts, ends, _ = c.pieces(buf, off)
    assert b"".join(buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)) == buf.tobytes()
    assert least(lambda: c.pieces(buf, off)) < 4 * least(lambda: X.hash_spans(buf, starts, ends))


def test_queries_encode_as_the_plain_library(spark, tmp_path):
    rows = [(1, "one <|endoftext|> two"), (2, "<|STARTOFTEXT|> three <|startoftext|>"), (3, "four")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for f, path, end, n in ((P10.op10_tokenfile, BYTE, 0, "n_tokens"), (P6.op6_packing, WORD, 1, "length")):
        tok = Tokenizer.from_file(path)
        want = {i: [*tok.encode(t, add_special_tokens=False).ids, end] for i, t in rows}
        got = {r.doc_id: (r[n], r.ids_crc32) for r in f(spark, str(tmp_path)).collect()}
        assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_files_round_trip(spark, tmp_path):
    texts = strange(60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as crc", "'s' as path")
    uri = f"file://{tmp_path}/ids"
    P10.write_token_files(df, uri, BYTE)
    got = P10.read_token_files(spark, uri).collect()
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    enc = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted((str(i), len(enc(t)), zlib.crc32(np.array(enc(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    shards, d = P10.load_manifest(uri)
    s = P10.ShardReader(shards[0]["path"], d)
    assert s.ids(0).tolist() == enc("no id")
    with pytest.raises(ValueError):
        P10.ShardReader(shards[0]["path"], b"another")
    P10.write_token_files(df.where("false"), f"file://{tmp_path}/none", BYTE)
    assert P10.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rnd, cap = random.Random(seed), random.Random(seed).choice([12, 64, 4096])
    hist = {rnd.randint(1, cap): rnd.choice([1, 2, 3, 7, 1000]) for _ in range(rnd.randint(1, 60))}
    slots, total = P6.plan(hist, cap)
    fill, seen, big = {}, {a: [] for a in hist}, {}
    for length, lo, n, k, first, offset in slots:
        for i in range(n):
            fill.setdefault(first + i // k, []).append((offset + i % k * length, length))
            seen[length].append(lo + i)
            big[first + i // k] = big.get(first + i // k, 0) + (3 * length > cap)
    assert all(sorted(seen[a]) == list(range(n)) for a, n in hist.items())
    assert sorted(fill) == list(range(total)) and max(big.values()) <= 2
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    lower = -(-sum(a * n for a, n in hist.items()) // cap)
    first_fit = []
    for a in sorted((a for a, n in hist.items() for _ in range(n)), reverse=True):
        j = next((j for j, f in enumerate(first_fit) if f + a <= cap), None) if len(first_fit) < 400 else None
        if j is None:
            first_fit.append(a)
        else:
            first_fit[j] += a
    assert lower <= total <= max(len(first_fit), lower) * 1.1 + 2


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b " * 9000), (-4, "same"), (-4, "same"), (None, "no id")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    got = P6.pack(P6.cut(P6.cut_and_encode(df, WORD))).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by[-4]) == 2 and len(by[None]) == 1 and by[-1][0].length == 1
    long = sorted(by[-3], key=lambda r: r.piece)
    assert [r.start for r in long] == [4096 * i for i in range(len(long))] and all(r.length == 4096 for r in long[:-1])
    tokens = sum(r.length for r in got)
    assert len(seq) <= -(-tokens // 4096) * 1.02 + 1
    assert P6.pack(P6.cut(P6.cut_and_encode(df.where("false"), WORD))).count() == 0
