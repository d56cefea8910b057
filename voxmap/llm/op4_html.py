"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block tags, each with the stack of its open block elements. A block
has features of its ancestors (tags, and the words of their class, id and role) and of its text (length, links, end
sign, place). The field has two labels, content and rest; it is trained on generated labelled pages of many layouts by
gradient ascent on the conditional likelihood (forward-backward), and a page is decoded by Viterbi.

Scripts, styles, comments and the head are never text. Character references are decoded, white space inside a block is
one space, content blocks are joined by a newline in page order; nothing else is dropped or cut, whatever the length.

Defined results: null, empty or textless html gives '' with 0 characters; broken markup is read as far as it goes;
repeated rows and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmap.llm._util import table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)", re.S)
_EASY = re.compile(r"(?:[ \t\n\f\r]++[a-zA-Z][\w:.-]*+=(?:\"[^\"<>]*+\"|'[^'<>]*+'))*+[ \t\n\f\r]*+/?>")
#: an attribute up to the quote that opens its value, or whole; a quote opens a value only after =
_OPEN = re.compile(r"[ \t\n\f\r/]*+=?+[^ \t\n\f\r/<>=]*+[ \t\n\f\r]*+(?:=[ \t\n\f\r]*+(?:([\"'])|[^ \t\n\f\r<>\"'][^ \t\n\f\r<>]*+)?)?+")
_ATTR = re.compile(r"[ \t\n\f\r/]*+(=?+[^ \t\n\f\r/<>=]*+)[ \t\n\f\r]*+(?:=[ \t\n\f\r]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r<>\"'][^ \t\n\f\r<>]*+))?)?+")
_FIRST = re.compile(r"[<>]")
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("script style noscript template textarea select svg iframe object canvas head title audio video math".split())
#: searched in the page itself: lower() changes its length ('İ'), and only ASCII letters of a tag name have two cases
_ENDS = {name: re.compile("</head|<body" if name == "head" else f"</{name}", re.I | re.A) for name in SKIP}
EMPTY = frozenset({"hr"})
NAMING = frozenset({"class", "id", "role"})
#: a start tag ends an open element of these kinds, up to the nearest of the others
IMPLIED = {"p": ({"p"}, BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}), "li": ({"li"}, {"ul", "ol", "menu", "nav"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_BLOCK_ENDS_P = BLOCK - {"button", "label", "summary", "legend", "caption"}
_NAME = re.compile(r"[a-z]+")


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the > of the tag stands whose name ends at `at`; -1: this is no tag.

    Quoted values have any length. A tag ends before the next < outside quotes; one that does so without >, or with a
    quote that nothing closes, ends at the first > before any <. dead: ends of values, from which earlier scans of the
    page came to nothing; with it broken markup is read in linear time.
    """
    if m := _EASY.match(page, at):
        return m.end() - 1
    pos, seen = at, []
    while pos not in dead:
        m = _OPEN.match(page, pos)
        if m[1]:
            k = page.find(m[1], m.end())
            if k < 0:
                break
            pos = k + 1
            seen.append(pos)
        elif m.end() > pos:
            pos = m.end()
        elif page[pos : pos + 1] == ">":
            return pos
        else:
            break
    dead.update(seen)
    m = _FIRST.search(page, at)
    return m.start() if m and m[0] == ">" else -1


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(stack of open block elements, text, characters of it in links); an element is 'tag' or 'tag word word ...'."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[str] = []
    parts: list[str] = []
    state = [0, 0]  # open links, characters in links

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(stack), text, state[1]))
            parts.clear()
        state[1] = 0

    def add(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state[0]:
                state[1] += len(text.strip())

    def close(names, barrier) -> None:
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i].split(" ", 1)[0]
            if tag in names:
                del stack[i:]
                return
            if tag in barrier:
                return

    at, look = 0, 0
    endless: set[str] = set()  # elements without an end tag from here on
    n = len(page)
    dead: set[int] = set()
    while at < n:
        m = _TAG.search(page, look)
        if m is None:
            add(page[at:])
            break
        if m[2] and (stop := _tag_end(page, m.end(), dead)) < 0:
            look = m.end()
            continue
        add(page[at : m.start()])
        at = look = stop + 1 if m[2] else m.end()
        if not m[2]:
            continue
        name, end, attrs = m[2].lower(), bool(m[1]), page[m.end() : stop]
        if name in SKIP:
            if not end and not attrs.endswith("/"):
                m = _ENDS[name].search(page, at) if name not in endless else None
                if m is None:
                    endless.add(name)
                if name == "head":  # its end tag may be missing
                    at = look = m.start() if m else at
                    continue
                k = page.find(">", m.end()) if m else -1
                at = look = n if k < 0 else k + 1
            continue
        if name == "a":
            state[0] = 0 if end else 1
        elif name in ("br", "img", "input", "wbr"):
            if name != "wbr":
                parts.append(" ")
        elif name in BLOCK:
            flush()
            state[0] = 0
            if end:
                close({name}, () if name not in ("p", "li") else BLOCK - {name, "p"})
            else:
                if name in _BLOCK_ENDS_P:
                    close({"p"}, BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
                if name in IMPLIED:
                    close(*IMPLIED[name])
                if name not in EMPTY:
                    words = " ".join(w for a in _ATTR.finditer(attrs) if a[1].lower() in NAMING for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())) if attrs else ""
                    stack.append(f"{name} {words}" if words else name)
    flush()
    return out


def stack_features(stack: tuple[str, ...]) -> list[str]:
    f = {"stack"}
    for e in stack:
        tag, *words = e.split(" ")
        f.add(f"in {tag}")
        f.update(f"word {w}" for w in words)
    if stack:
        tag, *words = stack[-1].split(" ")
        f.add(f"own {tag}")
        f.update(f"own word {w}" for w in words)
        if len(stack) > 1:
            f.add(f"parent {stack[-2].split(' ')[0]} {tag}")
    names = {e.split(" ")[0] for e in stack}
    f.add("main" if names & {"article", "main"} else "no main")
    return sorted(f)


def text_features(text: str, links: int, place: int, count: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    last = text[-1]
    return [
        f"words {min(words.bit_length(), 8)}",
        f"links {min(4, 4 * links // max(1, n))}",
        "sentence" if last in ".!?…\"'”’»" else "open end",
        "first" if place == 0 else "last" if place == count - 1 else "between",
        "sign" if "©" in text or "·" in text or "|" in text else "no sign",
    ]


def _forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals and summed transition marginals for emissions e (n x 2) and transitions t (2 x 2)."""
    n = len(e)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for i in range(1, n):
        a[i] = e[i] + np.logaddexp(a[i - 1, 0] + t[0], a[i - 1, 1] + t[1])
    for i in range(n - 2, -1, -1):
        x = e[i + 1] + b[i + 1]
        b[i] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
    z = np.logaddexp(*a[-1])
    pair = np.zeros((2, 2))
    if n > 1:
        pair = np.exp(a[:-1, :, None] + t + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
    return np.exp(a + b - z), pair


class Field:
    """Weights of the features for content (the rest has weight 0) and of the label transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights.tolist(), moves.tolist()
        self.stacks: dict[tuple[str, ...], float] = {}

    def emission(self, features: list[str]) -> float:
        return sum(self.weights[self.names[f]] for f in features if f in self.names)

    def content(self, page: str | None) -> list[str]:
        blocks = leaf_blocks(page) if page else []
        if not blocks:
            return []
        scores = []
        for k, (stack, text, links) in enumerate(blocks):
            if stack not in self.stacks:
                if len(self.stacks) > 50_000:
                    self.stacks.clear()
                self.stacks[stack] = self.emission(stack_features(stack))
            scores.append(self.stacks[stack] + self.emission(text_features(text, links, k, len(blocks))))
        (aa, ab), (ba, bb) = self.moves
        rest, main, back = 0.0, scores[0], []
        for s in scores[1:]:
            back.append((rest + aa < main + ba, rest + ab < main + bb))
            rest, main = max(rest + aa, main + ba), max(rest + ab, main + bb) + s
        label = main > rest
        keep = [label]
        for b in reversed(back):
            label = b[label]
            keep.append(label)
        return [b[1] for b, k in zip(blocks, reversed(keep), strict=True) if k]


def train(pages: list[tuple[str, list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Fit a field to (html, label of each leaf block) pairs; Adagrad on the conditional log-likelihood."""
    names: dict[str, int] = {}
    data = []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a label for each leaf block is needed")
        if blocks:
            rows = [[names.setdefault(f, len(names)) for f in stack_features(s) + text_features(t, links, k, len(blocks))] for k, (s, t, links) in enumerate(blocks)]
            data.append((rows, np.array(labels)))
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    gw, gt = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    order = random.Random(4)
    for _ in range(epochs):
        order.shuffle(data)
        for rows, y in data:
            e = np.zeros((len(rows), 2))
            e[:, 1] = [w[r].sum() for r in rows]
            p, pair = _forward_backward(e, t)
            g = np.zeros(len(w))
            flat = np.concatenate(rows)
            np.add.at(g, flat, np.repeat(y - p[:, 1], [len(r) for r in rows]))
            used = np.unique(flat)
            g = g[used] - decay * w[used]
            gw[used] += g * g
            w[used] += rate * g / np.sqrt(gw[used])
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            d = seen - pair - decay * t
            gt += d * d
            t += rate * d / np.sqrt(gt)
    return Field(names, w, t)


class Layout:
    """A generator of labelled pages: random layouts of an article among menus, notices, adverts, forms and comments."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syl = ["".join(self.r.choice(s) for s in ("bdfglmnprstv", "aeiouäéñ", ["", "n", "r", "s", "t"])) for _ in range(60)]

    def words(self, a: int, b: int) -> str:
        text = " ".join("".join(self.r.choice(self.syl) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(a, b)))
        return text.capitalize() + self.r.choice([".", ".", ".", "!", "?", "", "&amp;", " &copy;" if self.r.random() < 0.1 else "."])

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        self.labels.append(label)
        return f"<{tag}{attrs}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or self.r.random() < 0.85 else "")

    def links(self, n: int, wrap: bool = True) -> str:
        one = lambda: f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 4).rstrip(".!?")}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(self.block("li", one(), 0) for _ in range(n)) + "</ul>"
        return self.block("div", " | ".join(one() for _ in range(n)), 0)

    def classed(self, tag: str, names: str) -> tuple[str, str]:
        c = self.r.choice(names.split())
        return tag, f' {self.r.choice(["class", "class", "id"])}="{c}{self.r.choice(["", "", "-" + self.r.choice(["box", "area", "wrap", "main", "top", "inner"])])}"'

    def junk(self) -> str:
        r = self.r
        kind = r.randint(0, 8)
        if kind == 0:
            tag, a = ("nav", "") if r.random() < 0.7 else self.classed("div", "nav menu navbar navigation breadcrumb breadcrumbs toolbar pagination")
            return f"<{tag}{a}>{self.links(r.randint(2, 8))}</{tag}>"
        if kind == 1:
            tag, a = self.classed(r.choice(["div", "aside", "section"]), "ad ads advert advertisement banner sponsored promo sponsor adsbox")
            return f"<{tag}{a}>" + (self.block("p", self.words(3, 30), 0) if r.random() < 0.5 else self.bare(self.words(3, 30))) + f"</{tag}>"
        if kind == 2:
            tag, a = self.classed(r.choice(["div", "section", "aside"]), "cookie cookies consent notice gdpr newsletter subscribe alert modal popup disclaimer")
            return f"<{tag}{a}>" + self.block("p", self.words(5, 40), 0) + (self.block("button", self.words(1, 2), 0) if r.random() < 0.6 else "") + f"</{tag}>"
        if kind == 3:
            tag, a = ("aside", "") if r.random() < 0.6 else self.classed("div", "sidebar side widget related recommended more trending popular share social")
            return f"<{tag}{a}>" + self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0) + (self.links(r.randint(2, 6)) if r.random() < 0.6 else self.block("p", self.words(5, 40), 0)) + f"</{tag}>"
        if kind == 4:
            return "<form>" + self.block("label", self.words(1, 4), 0) + "<input>" + (self.block("button", self.words(1, 2), 0) if r.random() < 0.7 else "") + (self.block("p", self.words(3, 20), 0) if r.random() < 0.5 else "") + "</form>"
        if kind in (5, 6):
            tag, a = self.classed(r.choice(["div", "section"]), "comments comment responses discussion replies reply disqus")
            inner = "".join(self.block(r.choice(["p", "p", "div", "li", "article"]), self.words(3, 50), 0) for _ in range(r.randint(1, 5)))
            return f"<{tag}{a}>" + (self.block("h3", self.words(1, 3), 0) if r.random() < 0.6 else "") + inner + f"</{tag}>"
        if kind == 7:
            return "<header>" + (self.block(r.choice(["div", "p", "h1", "h2"]), self.words(1, 5), 0)) + (self.links(r.randint(2, 6)) if r.random() < 0.6 else "") + "</header>"
        tag, a = ("footer", "") if r.random() < 0.7 else self.classed("div", "footer copyright legal bottom colophon")
        return f"<{tag}{a}>" + (self.block("p", "&copy; " + self.words(2, 20), 0) if r.random() < 0.5 else self.bare("&copy; x.example &middot; " + self.words(2, 20))) + f"</{tag}>"

    def bare(self, text: str) -> str:
        self.labels.append(0)
        return text

    def body(self) -> str:
        r = self.r
        out = [self.block(r.choice(["h1", "h1", "h2"]), self.words(2, 12), 1)] if r.random() < 0.9 else []
        if out and r.random() < 0.15:
            out[0] = f"<header>{out[0]}</header>"
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.7:
                t = self.words(1, 90)
                if r.random() < 0.2:
                    t = f"<b>{t}<br>" if r.random() < 0.5 else f'{t} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 20)}'
                out.append(self.block("p", t, 1))
            elif k < 0.76:
                out.append(self.block(r.choice(["h2", "h3"]), self.words(1, 6), 1))
            elif k < 0.82:
                out.append("<ul>" + "".join(self.block("li", self.words(2, 20), 1) for _ in range(r.randint(2, 4))) + "</ul>")
            elif k < 0.86:
                out.append(f"<blockquote>{self.block('p', self.words(4, 40), 1)}</blockquote>")
            elif k < 0.89:
                out.append(self.block("pre", self.words(4, 20), 1))
            elif k < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.words(1, 4), 1) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.95:
                out.append(f"<figure><img>{self.block('figcaption', self.words(2, 12), 1)}</figure>")
            else:
                out.append(self.junk())
        return "".join(out)

    def page(self) -> tuple[str, list[int]]:
        r, self.labels = self.r, []
        out = [f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var t='</p>';</script></head><body>"]
        out += [self.junk() for _ in range(r.randint(0, 4))]
        tag, a = r.choice([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("main", ""), self.classed("div", "content post entry story article text body page"), ("div", ""), ("section", ""), ("", "")])
        inner = self.body()
        if tag == "main" and r.random() < 0.4:
            inner = f"<article>{inner}</article>"
        out.append(f"<{tag}{a}>{inner}</{tag}>" if tag else inner)
        out += [self.junk() for _ in range(r.randint(0, 4))]
        return "".join(out) + ("</body></html>" if r.random() < 0.8 else ""), self.labels


@functools.lru_cache
def default_field(pages: int = 1000, seed: int = 12) -> Field:
    g = Layout(seed)
    return train([g.page() for _ in range(pages)])


def _extract(field):
    def run(batches):
        f = field.value
        for b in batches:
            text = ["\n".join(f.content(h.as_py())) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for pages(page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())  # a few thousand weights
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
