import zlib

import numpy as np
import pyarrow as pa

from voxmap.llm import op8_language as L
from voxmap.llm import op9_quality as Q

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.op8_language(spark, SF).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_grams_by_hand():
    a, b = ord("a"), ord("b")
    want = [a, b, a, a, a << 21 | b, b << 21, a, a << 21, (a << 21) | b, ((a << 21) | b) << 21, (a << 21)]
    assert sorted(L.grams("Ab, a!").tolist()) == sorted(want)
    assert not len(L.grams("12 !?")) and not len(L.grams(""))
    m = L.Model({"x": L.ranked_grams("aab aab", 5).tolist(), "y": L.ranked_grams("zzq", 5).tolist()}, 5)
    assert m.predict("aab") [0] == "x" and m.predict("zzq")[0] == "y"
    assert m.predict(None) == ("und", 0.0) and m.predict("!1") == ("und", 0.0)
    assert L.Model({}, 5).predict("abc") == ("und", 0.0)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12", None), (None, "the the of", "en"), (5, "the of and", "en"), (5, "the of and", "en"), (6, "der die das " * 100_000, None), (7, "der die und das", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as h", "true as held_out", "3 as top", "4 as r", "5 as code")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(df, L.learn(df)).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (6, "de"), (7, "de")}
    assert L.identify(df.where("false"), L.learn(df.where("false"))).count() == 0


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Q.op9_quality(spark, SF).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good = np.array([r.score for r in held if truth[r.doc_id] == 1])
    bad = np.array([r.score for r in held if truth[r.doc_id] == 0])
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) > 0.95


def test_quality_tokens_and_edges(spark):
    text = ["Ab AB! 12", None, "", "x"]
    col = pa.array(text)
    lo, hi, buf, off = next(Q.X.text_chunks(col))
    w, kind, caps, first, length = Q.tokens(buf, off)
    assert kind.tolist() == [1, 1, 3, 2, 1] and caps.tolist() == [False, True, False, False, False] and first.tolist() == [0, 4, 4, 4, 5]
    assert w[0] == w[1] and length.tolist() == [2, 2, 1, 2, 1]
    docs = spark.createDataFrame([(1, "a b"), (None, "b c"), (2, None), (2, ""), (3, "z " * 500_000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as quality", "3 as f")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs.select("doc_id", "text"), Q.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs.select("doc_id", "text"), Q.fit(docs, one)).collect()} == {1.0}
    assert Q.score(docs.where("false").select("doc_id", "text"), Q.fit(docs.where("false"), none)).count() == 0


def test_network_learns_and_is_calibrated():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (r.random(4000) < p).astype(int)
    s = Q.Network(x[:3000], y[:3000]).score(x[3000:])
    assert abs(s.mean() - y[3000:].mean()) < 0.05 and np.abs(s - p[3000:]).mean() < 0.15
