import re
import time
from itertools import product

import numpy as np

from voxmap.llm import op4_html as H

SF = "/root/testdata/sf0.01"


def test_forward_backward_and_viterbi_by_enumeration():
    r = np.random.default_rng(1)
    e, t = np.column_stack([np.zeros(6), r.normal(size=6)]), r.normal(size=(2, 2))
    runs = list(product((0, 1), repeat=6))
    s = np.array([sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in runs])
    w = np.exp(s) / np.exp(s).sum()
    p, pair = H._forward_backward(e, t)
    assert np.allclose(p[:, 1], [sum(x for x, y in zip(w, runs, strict=True) if y[i]) for i in range(6)])
    assert np.allclose(pair[1, 0], sum(x * sum(a == 1 and b == 0 for a, b in zip(y, y[1:], strict=False)) for x, y in zip(w, runs, strict=True)))
    f = H.Field({f"words {k}": k for k in range(9)}, r.normal(size=9) * 2, t)
    page = "".join(f"<p>{'w ' * n}x</p>" for n in (0, 3, 40, 9, 1, 90, 2))
    e = [f.weights[f.names[H.text_features(x, 0, 0, 1)[0]]] for _, x, _ in H.leaf_blocks(page)]
    best = max(product((0, 1), repeat=7), key=lambda p: sum(a * y for a, y in zip(e, p, strict=True)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert f.content(page) == [x for (_, x, _), y in zip(H.leaf_blocks(page), best, strict=True) if y]


def test_held_out_pages():
    f, g = H.default_field(), H.Layout(999)
    right = total = whole = 0
    for _ in range(200):
        page, y = g.page()
        blocks = H.leaf_blocks(page)
        want = [b[1] for b, k in zip(blocks, y, strict=True) if k]
        got = f.content(page)
        whole += got == want
        right += len(set(got) & set(want)) * 2
        total += len(set(got)) + len(set(want))
    assert right / total > 0.95 and whole > 120


def test_markup():
    blocks = H.leaf_blocks("<p class='A-b x'>a&amp;b  c\n<b>d</b><br>e<p>f <a title='>'>g</a><script>if (a<b) '</p>'</script>h<!-- <p>no --><div>i<ul><li>j<li>k</ul></div>l < m <td")
    assert [(s[-1] if s else "", t, n) for s, t, n in blocks] == [("p a b x", "a&b c d e", 0), ("p", "f gh", 1), ("div", "i", 0), ("li", "j", 0), ("li", "k", 0), ("", "l < m <td", 0)]
    assert H.leaf_blocks("") == [] and H.leaf_blocks("<p>") == [] and H.leaf_blocks("<script>x") == []
    t = time.time()
    H.leaf_blocks("<a " + '"' * 50_000 + "<p " * 20_000)
    assert time.time() - t < 20


def test_attribute_values_of_any_length():
    for n in (10, 1001, 100_000):
        for v in (f'"{"x" * n}>y"', f"'{'x' * n}<p class=\"ad\">y</p>'", f'"data:image/svg+xml,<svg a=\'1\'>{"x" * n}</svg>"'):
            page = f"<article><div data-a={v} class=main>text</div><p title = {v}>more</article>"
            assert H.leaf_blocks(page) == [(("article", "div main"), "text", 0), (("article", "p"), "more", 0)], v[:50]
    assert H.leaf_blocks("<p 5\" x=it's>a<p>b \"c\" d's") == [(("p",), "a", 0), (("p",), "b \"c\" d's", 0)]
    assert H.leaf_blocks('<p title="a>b<p>c') == [(("p",), "b", 0), (("p",), "c", 0)]
    for bad in ('<a x="<b " ' + 'x="<b " ' * 100_000, "<a x='" + '<a x="' * 100_000, "<a " * 100_000, '<a x="<b y=\'" ' * 100_000):
        t = time.time()
        H.leaf_blocks(bad)
        assert time.time() - t < 5


def test_letters_whose_lower_case_is_longer():
    page = "<html><head><title>İİ</title></HEAD><body><p>İİİ İstanbul<SCRIPT>var a = 1;</Script>abc def</p><style>p</style>ghi<script>b</ſcript>c</script>jkl"
    assert [t for _, t, _ in H.leaf_blocks(page)] == ["İİİ İstanbulabc def", "ghijkl"]


def test_pages(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = H.op4_html(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        art = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        want = "\n".join(b[1] for b in H.leaf_blocks(art))
        assert r.text == want and r.n_chars == len(want), (r.page_id, r.text[:200], want[:200])


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "x", "<article><p>Hello &eacute; there, this is a text.</article>"), (3, "y", "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"), (4, "z", "plain text only, without any markup at all.")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[None].text == "Hello é there, this is a text." and got[None].n_chars == 30
    assert got[3].n_chars == 20_000 * 16 - 1 + 20_000 - 0 or got[3].text.count("\n") == 19_999
    assert H.extract(df.where("false")).count() == 0
