"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the texts between borders of block elements. Each block has
features of its ancestors (tags, and the words of class, id and role) and of its text; a
two-label chain, trained on labelled pages and decoded by Viterbi, tells article from the rest.
The pages table has no labels, so the labelled pages are made here, by a generator that writes
articles into varied layouts and knows which blocks are which; it uses invented words only.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, private, table

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: No text of a page: left out with all inside.
RAW = ("script", "style", "title", "iframe", "noscript", "template", "textarea", "svg", "math", "object")
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(" + "|".join(RAW) + r")\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[!?/][^>]*(?:>|\Z)|/?[A-Za-z][^<>]*(?:>|\Z))|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
P_ENDS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Open:
    """The open elements: where each tag stands, and the features of all of them, kept up as they come and go."""

    def __init__(self, known):
        self.known, self.stack, self.places, self.count, self.path = known, [], {}, {}, frozenset()

    def push(self, tag: str, features: tuple[str, ...]) -> None:
        features = features if self.known is None else tuple(f for f in features if f in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, features))
        for f in features:
            self.count[f] = self.count.get(f, 0) + 1
            if self.count[f] == 1:
                self.path = None

    def last(self, tags) -> int:
        """The place of the innermost element of these tags, -1 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > place:
            tag, features = self.stack.pop()
            self.places[tag].pop()
            for f in features:
                self.count[f] -= 1
                if not self.count[f]:
                    del self.count[f]
                    self.path = None

    def features(self) -> frozenset[str]:
        if self.path is None:
            self.path = frozenset(self.count)
        return self.path


SCOPE = ("ul", "ol", "table", "article", "div", "section", "body")
CLOSES = {t: ("p",) for t in P_ENDS} | {t: (t,) for t in ("li", "option", "tr", "td", "th")} | {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "body": ("head",)}


def blocks(page: str | None, known=None) -> list[tuple[str, frozenset[str], int]]:
    """(text, features of the ancestors, characters inside links) of each leaf block, in page order; only known features, if they are given."""
    opened = Open(known)
    stack = opened.stack
    out, held, linked = [], [], 0

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, opened.features(), min(linked, len(text))))
            held, linked = [], 0

    for m in TOKEN.finditer(page or ""):
        s = m[0]
        if s[0] != "<" or s == "<":
            if not any(t == "head" for t, _ in stack[:2]):
                held.append(s)
                if any(t == "a" for t, _ in stack[-3:]):
                    linked += len(s.strip())
            continue
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and held:
                held.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                held.append(" " if tag != "wbr" else "")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            if (at := opened.last((tag,))) >= 0:
                opened.cut(at)
            continue
        if tag not in INLINE:
            closes = CLOSES.get(tag, ())
            at = opened.last(closes)
            if at >= 0 and at > opened.last(t for t in SCOPE if t not in closes):
                opened.cut(at)
        opened.push(tag, element(tag, m[4] or ""))
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def element(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its tag unless inline, and the words of class, id and role."""
    words = {w.lower() for m in ATTRIBUTE.finditer(attributes) for w in PART.findall(m[2] or m[3] or m[4] or "")} if attributes else set()
    return (() if tag in INLINE else (f"in:{tag}",)) + tuple(sorted(f"c:{w}" for w in words))


def text_features(text: str, linked: int, at: int, n: int) -> list[str]:
    size = len(text)
    share = linked / max(1, size)
    return [
        f"size:{min(6, size.bit_length() // 2)}", f"links:{0 if not linked else 1 if share < 0.5 else 2}", f"end:{text[-1] in '.!?…:\"”'}",
        f"words:{min(4, text.count(' ').bit_length())}", "first" if at == 0 else "last" if at == n - 1 else "inside", *(["sign"] if "©" in text else []),
    ]


class Field:
    """Weights towards `article` of each feature, and of each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.paths: dict[frozenset[str], float] = {}

    def unary(self, found) -> list[float]:
        w, out = self.weights, []
        for i, (text, path, linked) in enumerate(found):
            p = self.paths.get(path)
            if p is None:
                p = fsum(w.get(f, 0.0) for f in path)
                if len(self.paths) < 1 << 14:
                    self.paths[path] = p
            out.append(p + sum(w.get(f, 0.0) for f in text_features(text, linked, i, len(found))) + w.get("bias", 0.0))
        return out

    def decode(self, found) -> list[bool]:
        """The best labelling (Viterbi)."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.moves
        back, a, b = [], 0.0, 0.0
        for i, u in enumerate(self.unary(found)):
            if i:
                to0, to1 = (a + m00 >= b + m10), (a + m01 >= b + m11)
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
                back.append((0 if to0 else 1, 0 if to1 else 1))
            b += u
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]

    def text(self, page: str | None) -> str:
        found = blocks(page, self.weights)
        return "\n\n".join(t for (t, _, _), y in zip(found, self.decode(found), strict=True) if y)


def train(pages: list[tuple[str, list[bool]]], epochs: int = 120, rate: float = 0.3, l2: float = 2e-3) -> Field:
    """A field for pages with a label for each leaf block, by gradient ascent on the likelihood (forward-backward)."""
    index: dict[str, int] = {}
    rows, feats, gold, where = [], [], [], []
    for s, (page, labels) in enumerate(pages):
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"page {s}: {len(found)} blocks, {len(labels)} labels")
        for i, ((text, path, linked), y) in enumerate(zip(found, labels, strict=True)):
            for f in sorted({*path, *text_features(text, linked, i, len(found)), "bias"}):
                rows.append(len(gold))
                feats.append(index.setdefault(f, len(index)))
            gold.append(int(y))
            where.append((s, i))
    rows, feats, gold, where = np.array(rows), np.array(feats), np.array(gold), np.array(where)
    n, longest = len(pages), where[:, 1].max() + 1
    there = np.zeros((n, longest), dtype=bool)
    there[where[:, 0], where[:, 1]] = True
    y = np.zeros((n, longest), dtype=int)
    y[where[:, 0], where[:, 1]] = gold
    w, moves = np.zeros(len(index)), np.zeros((2, 2))
    gw, gm = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    seen = np.zeros((2, 2))
    for t in range(1, longest):
        np.add.at(seen, (y[:, t - 1][there[:, t]], y[:, t][there[:, t]]), 1)
    for _ in range(epochs):
        u = np.zeros((n, longest, 2))
        u[where[:, 0], where[:, 1], 1] = np.bincount(rows, weights=w[feats], minlength=len(gold))
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = u[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves[None], axis=1) + u[:, t]
            fwd[:, t] = np.where(there[:, t, None], new, fwd[:, t - 1])
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves[None] + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(there[:, t + 1, None], new, bwd[:, t])
        p = np.exp(fwd + bwd - total[:, None, None])[where[:, 0], where[:, 1], 1]
        expected = np.zeros((2, 2))
        for t in range(1, longest):
            joint = np.exp(fwd[:, t - 1, :, None] + moves[None] + (u[:, t] + bwd[:, t])[:, None, :] - total[:, None, None])
            expected += joint[there[:, t]].sum(axis=0)
        step_w = np.bincount(feats, weights=(gold - p)[rows], minlength=len(index)) / n - l2 * w
        step_m = (seen - expected) / n - l2 * moves
        gw += step_w**2
        gm += step_m**2
        w += rate * step_w / np.sqrt(gw)
        moves += rate * step_m / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in index.items()}, moves.tolist())


# The kinds of blocks the generator writes, as (element, class) choices.
ARTICLE = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("div", "story"), ("section", "main-text"), ("div", "content"), ("td", "text"), ("div", "article")]
REST = [("nav", ""), ("nav", "menu"), ("ul", "nav-list"), ("div", "navbar menu"), ("div", "breadcrumb"), ("header", ""), ("header", "site-header"), ("div", "header top-bar"), ("footer", ""), ("div", "footer"), ("div", "copyright legal"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "related links"), ("div", "cookie-notice"), ("div", "notice banner alert"), ("div", "consent popup modal"), ("div", "ad"), ("div", "ads advert"), ("div", "advertisement sponsored promo"), ("form", ""), ("form", "newsletter subscribe"), ("form", "search login"), ("section", "comments"), ("div", "comment-list"), ("ol", "comments replies"), ("div", "comment reader discussion"), ("div", "share social"), ("div", "pagination tags meta"), ("dialog", ""), ("menu", "")]


def made_pages(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages and the labels of their leaf blocks."""
    r = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "en", "ar")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence():
        return r.choice([words(3, 25).capitalize() + ".", words(1, 3).capitalize() + ".", words(2, 8).upper() + "!!", words(2, 9) + r.choice(["", " ###", " |"])])

    def para():
        t = " ".join(sentence() for _ in range(r.randint(1, 6)))
        return r.choice([t, t, f"<b>{t}</b>", f'{t} <a href="/x">{words(1, 3)}</a>.', f"<em>{t}", f"{t}<br>"])

    def rest():
        tag, cls = r.choice(REST)
        k = r.randint(1, 6)
        kind = r.randint(0, 3)
        if kind == 0:
            items = [f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k)]
            body, count = "<ul>" + "".join(items) + "</ul>", k
        elif kind == 1:
            body, count = "".join(f"<p>{para()}</p>" for _ in range(k)), k
        elif kind == 2:
            body, count = r.choice(["&copy; ", ""]) + sentence(), 1
        else:
            body, count = f"<h3>{words(1, 3)}</h3>" + "".join(f"<div>{para()}</div>" for _ in range(k)), k + 1
        name = r.choice([f' class="{cls}"', f' id="{cls.split()[0]}"', f" class='x {cls}'"]) if cls else ""
        return f"<{tag}{name}>{body}</{tag}>", [False] * count

    def article():
        tag, cls = r.choice(ARTICLE)
        parts, count = [], 0
        if r.random() < 0.8:
            head = f"<h1>{words(2, 9).capitalize()}{r.choice(['', '.'])}</h1>"
            parts.append(r.choice([head, head, f"<header>{head}</header>"]))
            count += 1
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.75:
                parts.append(r.choice([f"<p>{para()}</p>", f"<p>{para()}"]))
                count += 1
            elif kind < 0.85:
                k = r.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(k)) + "</ul>")
                count += k
            elif kind < 0.93:
                parts.append(f"<h2>{words(1, 6)}</h2><blockquote>{para()}</blockquote>")
                count += 2
            else:
                parts.append(f"<pre>{words(2, 9)}</pre>")
                count += 1
        name = f' class="{cls}"' if cls else ""
        whole, labels = f"<{tag}{name}>" + "".join(parts), [True] * count
        if r.random() < 0.2:  # an advert or comments inside
            more, own = rest()
            whole, labels = whole + more, labels + own
        return whole + f"</{tag}>", labels

    out = []
    for _ in range(n):
        before, after = ([rest() for _ in range(r.randint(a, b))] for a, b in ((0, 4), (0, 5)))
        parts = [*before, article(), *after]
        body = r.choice(["", "<!-- x -->", "<script>a('</p>')</script>"]).join(p for p, _ in parts)
        if r.random() < 0.5:
            body = r.choice(['<div id="wrapper">{}</div>', '<div class="page container">{}</div>']).format(body)
        out.append((f"<html><head><title>{words(2, 5)}</title></head><body>{body}</body></html>", [y for _, ys in parts for y in ys]))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 400) -> Field:
    return train(made_pages(pages))


def extract(df: DataFrame, page: str = "html", keep: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """Adds text, the blocks of the article joined by blank lines, and n_chars, its code points.

    keep names the columns carried along (all but the page by default); columns of the new names,
    in any case, are replaced. A null or empty page, and one without an article, gives an empty text; pages that
    break off are read as far as they go. Rows are handled one by one: repeated ones stay.
    """
    prepare(df.sparkSession)
    field = field or trained()
    field.paths.clear()
    new = ["text", "n_chars"]
    kept = [c for c in (keep or [c for c in df.columns if c != page]) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{page}`").alias(private(df) + "page"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [field.text(p.as_py()) for p in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The article's text of every whole page of pages, by the field that trained() fits. Null pages give empty texts; see extract."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
