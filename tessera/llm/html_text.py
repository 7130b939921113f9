"""Main text of web pages by gradient-boosted trees over the nodes of the page.

A page becomes a tree of block nodes whose leaves are runs of text. Every node gets features (tag, attribute tokens of
itself and its ancestors, text, link and punctuation density of its subtree, depth, place among its siblings), the trees
give the chance that it holds main text, and decoding picks the most likely labelling in which a node holds main text if
and only if one of its children does. The trees are trained here, on pages that a generator writes together with their
labels: many site layouts, with semantic tags or plain divs, and pages without an article.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table, with_fields

# ---------------------------------------------------------------- parsing

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object textarea select title audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr input".split())
#: Tags that an opening tag closes if they are open (up to the named boundary).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
#: What an attribute value holds if its quote was never closed: the end of its tag, then more tags.
SPILT = re.compile(r">[^<]*+<(?:/[a-zA-Z]|[a-zA-Z]++[\s>])")
ATTR = re.compile(r"(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Attribute tokens by what they say of a node.
LEXICON = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip links share sharing social tags tag related".split(),
    "head": "header masthead topbar branding logo banner hdr".split(),
    "foot": "footer foot colophon copyright legal bottom contentinfo ftr".split(),
    "side": "sidebar side aside widget rail related recommended popular trending complementary more teaser".split(),
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion adsense adslot commercial".split(),
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay toast warning message banner privacy notification disclaimer".split(),
    "form": "form search login signup signin subscribe subscription newsletter register".split(),
    "comment": "comment comments disqus reply replies discussion respond reader readers feedback response responses thread".split(),
    "main": "article content main post entry story body text prose maincontent articlebody".split(),
}
KINDS = list(LEXICON)
_TOKENS = {}
for _i, _k in enumerate(KINDS):
    for _w in LEXICON[_k]:
        _TOKENS[_w] = _TOKENS.get(_w, 0) | 1 << _i
HIDDEN = 1 << len(KINDS)
TAGS = [["article"], ["main"], ["section"], ["div"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "dl", "menu"], ["li", "dt", "dd"], ["table", "tbody", "thead", "tr", "td", "th"], ["nav"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "button", "legend"], ["blockquote", "pre", "q"], ["figure", "figcaption"], ["body", "html"], ["head"]]
TAG_ID = {t: i for i, ts in enumerate(TAGS) for t in ts}
OTHER = len(TAGS)


@lru_cache(1 << 14)
def flags_of(attrs: str) -> int:
    """The kinds that the attribute tokens of a tag name, as bits."""
    out = 0
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out |= HIDDEN
        elif name != "style":
            for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value):
                w = w.lower()
                out |= _TOKENS.get(w, 0)
                if len(w) > 6:  # compounds written as one word
                    for k in ("comment", "sidebar", "footer", "header", "advert", "cookie", "newsletter", "article", "content", "menu", "related"):
                        if k in w:
                            out |= _TOKENS[k]
    return out


def tags(source: str):
    """(start, end, closing, name, attributes) of the tags of a page in order; comments and declarations have no name.

    Each character is looked at a bounded number of times. A quote that is not closed, or only by a later tag's quote,
    is no quote: the tag ends at its first `>`. A tag or comment that never ends reaches to the end of the page.
    """
    at, n, last = 0, len(source), source.rfind(">")
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= n:
            return
        c = source[at + 1]
        if c in "!?":
            close = "-->" if source.startswith("<!--", at) else ">"
            end = source.find(close, at + (4 if close == "-->" else 2))
            end = end + len(close) if end >= 0 else n
            yield at, end, "", None, ""
            at = end
        elif c.isascii() and c.isalpha() or c == "/" and source[at + 2 : at + 3].isascii() and source[at + 2 : at + 3].isalpha():
            if at > last:
                yield at, n, "", None, ""
                return
            m = TAG.match(source, at)
            spilt = m is None or "<" in m.group(3) and SPILT.search(m.group(3))
            if spilt:  # without quotes
                end = source.index(">", at)
                name = re.compile(r"[^\s/>]+").match(source, at + 1 + (c == "/")).group()
                yield at, end + 1, "/" if c == "/" else "", name.lower(), source[at + 1 + (c == "/") + len(name) : end]
                at = end + 1
            else:
                yield at, m.end(), m.group(1), m.group(2).lower(), m.group(3)
                at = m.end()
        else:
            at += 1


@lru_cache(256)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*+>", re.I)


class Page:
    """Nodes in page order (parents first): tag, parent, flags, and for leaves the text and its characters in links.

    Inline elements make no nodes, so they never part a word; what they are named counts for nothing.
    """

    __slots__ = ("tag", "parent", "flags", "text", "link", "inputs")

    def __init__(self, source: str):
        self.tag, self.parent, self.flags, self.text, self.link, self.inputs = [OTHER], [-1], [0], [None], [0], [0]
        stack, names = [0], ["#root"]
        opened: dict[str, int] = {}
        run: list[str] = []
        links, in_a = 0, 0
        at, n = 0, len(source)

        def flush() -> None:
            nonlocal links
            if run:
                s = "".join(run)
                run.clear()
                if "&" in s:
                    s = entities.unescape(s)
                s = " ".join(s.split())
                if s:
                    top = stack[-1]
                    self.add(self.tag[top], top, self.flags[top], s, min(links, len(s)))
            links = 0

        def close(*which: str) -> None:
            """Close the innermost open element of these names and all in it."""
            while True:
                stack.pop()
                name = names.pop()
                opened[name] -= 1
                if name in which:
                    return

        for start, end, closing, name, attrs in tags(source):
            if start < at:
                continue
            if start > at:
                run.append(source[at:start])
                if in_a:
                    links += start - at
            at = end
            if name is None:
                continue
            if closing:
                if name == "a":
                    in_a = max(0, in_a - 1)
                elif opened.get(name):
                    flush()
                    close(name)
                    in_a = 0
                continue
            if name in DROPPED:
                if not attrs.endswith("/"):
                    stop = _closing(name).search(source, at)
                    at = stop.end() if stop else n
                    if name in ("select", "textarea"):
                        self.inputs[stack[-1]] += 1
                continue
            if name == "br":
                run.append(" ")
                continue
            if name == "input":
                self.inputs[stack[-1]] += 1
                continue
            if name in INLINE or name in VOID:
                if name == "a" and not attrs.endswith("/"):
                    in_a += 1
                elif name == "hr":
                    flush()
                continue
            flush()
            if name in ENDS_P and opened.get("p"):
                close("p")
            if name in CLOSES:
                kinds, stops = CLOSES[name]
                if any(opened.get(k) for k in kinds):
                    i = len(names) - 1
                    while names[i] not in kinds and names[i] not in stops:
                        i -= 1
                    if names[i] in kinds:
                        close(*kinds)
            in_a = 0
            if attrs.endswith("/") and name not in TAG_ID:
                continue
            self.add(TAG_ID.get(name, OTHER), stack[-1], flags_of(attrs) if attrs else 0, None, 0)
            stack.append(len(self.tag) - 1)
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
        if at < n:
            run.append(source[at:])
            if in_a:
                links += n - at
        flush()

    def add(self, tag: int, parent: int, flags: int, text: str | None, link: int) -> None:
        self.tag.append(tag)
        self.parent.append(parent)
        self.flags.append(flags)
        self.text.append(text)
        self.link.append(link)
        self.inputs.append(0)


# ---------------------------------------------------------------- features

N_TAGS, N_KINDS = OTHER + 1, len(KINDS) + 1
NUMBERS = 17
WIDTH = N_TAGS + 2 * N_KINDS + N_TAGS + NUMBERS
_PUNCT = str.maketrans("", "", ".,;:!?")


def features(p: Page) -> np.ndarray:
    n = len(p.tag)
    parent, text = p.parent, p.text
    chars, link, words, punct, nodes, inputs, paras = ([0] * n for _ in range(7))
    kids, order, depth, above, start = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    tags_above = [0] * n
    seen = 0
    for i in range(n):
        q = parent[i]
        t = text[i]
        start[i] = seen
        if t is not None:
            chars[i], link[i], words[i], punct[i] = len(t), p.link[i], t.count(" ") + 1, len(t) - len(t.translate(_PUNCT))
            seen += len(t)
            paras[i] = 1 if len(t) > 80 else 0
        inputs[i] = p.inputs[i]
        nodes[i] = 1
        if q >= 0:
            depth[i] = depth[q] + 1
            order[i] = kids[q]
            kids[q] += 1
            above[i] = above[q] | p.flags[i]
            tags_above[i] = tags_above[q] | 1 << p.tag[i]
        else:
            above[i], tags_above[i] = p.flags[i], 1 << p.tag[i]
    for i in range(n - 1, 0, -1):
        q = parent[i]
        chars[q] += chars[i]
        link[q] += link[i]
        words[q] += words[i]
        punct[q] += punct[i]
        nodes[q] += nodes[i]
        inputs[q] += inputs[i]
        paras[q] += paras[i]
    par = np.maximum(np.array(parent), 0)
    x = np.zeros((n, WIDTH), np.float32)
    x[np.arange(n), p.tag] = 1
    bits = lambda v, k: (np.array(v, np.int64)[:, None] >> np.arange(k)) & 1
    at = N_TAGS
    x[:, at : at + N_KINDS] = bits(p.flags, N_KINDS)
    at += N_KINDS
    x[:, at : at + N_KINDS] = bits(above, N_KINDS)
    at += N_KINDS
    x[:, at : at + N_TAGS] = bits(tags_above, N_TAGS)
    at += N_TAGS
    c, ln, w, pu, nd, inp, pa, kd, od, dp, st = (np.array(v, np.float64) for v in (chars, link, words, punct, nodes, inputs, paras, kids, order, depth, start))
    leaf = np.array([t is not None for t in text])
    total = max(seen, 1)
    numbers = [np.log1p(c), ln / np.maximum(c, 1), c / nd, pu / np.maximum(w, 1), np.log1p(w), dp, od / np.maximum(kd[par] - 1, 1), np.log1p(kd[par]), c / np.maximum(c[par], 1), c / total, st / total, inp, pa, np.log1p(nd), leaf, pa[par], ln[par] / np.maximum(c[par], 1)]
    x[:, at:] = np.stack(numbers, 1)
    return x


# ---------------------------------------------------------------- boosted trees

DEPTH, TREES, BINS = 4, 50, 32


def fit(x: np.ndarray, y: np.ndarray, rate: float = 0.25) -> dict:
    """Boosted trees for the logistic loss, by histograms of binned features; Newton steps in the leaves."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    inner = (1 << DEPTH) - 1
    feat, cut_, leaf = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1), np.float32)
    prior = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    f = np.full(len(y), prior)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            best, split = np.full(count, 1e-6), [(0, np.inf, BINS)] * count
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * BINS + binned[:, j]
                gs = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)
                hs = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                gain = gain[:, : len(e)]
                for k in np.flatnonzero(gain.max(1) > best).tolist():
                    b = int(gain[k].argmax())
                    best[k], split[k] = gain[k, b], (j, float(e[b]), b)
            for k, (j, v, _) in enumerate(split):
                feat[t, first + k], cut_[t, first + k] = j, v
            js, bs = np.array([s[0] for s in split]), np.array([s[2] for s in split])
            k = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), js[k]] > bs[k])
        k = node - inner
        leaf[t] = rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + 1)
        f += leaf[t][k]
    return {"feat": feat, "cut": cut_, "leaf": leaf, "prior": prior}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds that a node holds main text."""
    f, rows = np.full(len(x), model["prior"]), np.arange(len(x))
    for feat, cut_, leaf in zip(model["feat"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feat[node]] > cut_[node])
        f += leaf[node - len(feat)]
    return f


def decode(p: Page, odds: list[float]) -> list[str]:
    """Texts of the leaves that hold main text in the most likely consistent labelling.

    A node without main text has none below it; one with main text has a child with it. Leaves without text don't exist;
    elements without leaves are never main.
    """
    n = len(p.tag)
    gain, best_kid, some = [0.0] * n, [-math.inf] * n, [False] * n  # gain: kept children's surplus over none
    keep = [-math.inf] * n
    for i in range(n - 1, -1, -1):
        o = max(-12.0, min(12.0, odds[i]))
        if p.text[i] is not None:
            keep[i] = o
        elif some[i]:
            # at least one child is kept: the best one, if none gains
            keep[i] = o + (gain[i] if gain[i] > 0 else best_kid[i])
        q = p.parent[i]
        if q >= 0 and keep[i] > -math.inf:
            some[q] = True
            best_kid[q] = max(best_kid[q], keep[i])
            if keep[i] > 0:
                gain[q] += keep[i]
    out, chosen = [], [False] * n
    chosen[0] = keep[0] > 0
    for i in range(1, n):
        q = p.parent[i]
        chosen[i] = chosen[q] and (keep[i] > 0 or gain[q] <= 0 and keep[i] == best_kid[q])
        if chosen[i] and p.text[i] is not None:
            out.append(p.text[i])
    return out


# ---------------------------------------------------------------- generated training pages


def _text(r: random.Random, lo: int, hi: int) -> str:
    n, out, left = r.randint(lo, hi), [], 0
    for _ in range(n):
        w = "".join(r.choice(("th", "an", "re", "on", "ti", "es", "la", "qu", "ei", "mo", "st", "ch", "ö", "é", "ó", "nd")) for _ in range(r.randint(1, 4)))
        if left <= 0:
            w, left = w.capitalize(), r.randint(4, 18)
        left -= 1
        out.append(w + ("." if left <= 0 else "," if r.random() < 0.08 else ""))
    s = " ".join(out)
    return s.replace("th", "&amp;", 1) if r.random() < 0.1 else s


def generated(r: random.Random) -> tuple[str, set[str]]:
    """A page and the marks of its main paragraphs; every text starts with a mark of its own."""
    marks: set[str] = set()
    serial = [0]

    def say(lo: int, hi: int, main: bool = False) -> str:
        serial[0] += 1
        mark = f"m{serial[0]}x"
        if main:
            marks.add(mark)
        return f"{mark} {_text(r, lo, hi)}"

    def attrs(kind: str, always: bool = False) -> str:
        if not always and r.random() < 0.15:
            return ""
        w = r.choice(LEXICON[kind])
        w = r.choice([w, w, f"{r.choice(['site', 'page', 'main', 'l', 'top', 'box', 'c', 'block'])}-{w}", f"{w}-{r.choice(['box', 'list', 'wrap', 'area', 'inner', '1'])}", f"{r.choice(['js', 'my', 'the'])}{w.capitalize()}"])
        return f' {r.choice(["class", "class", "id"])}="{w}"'

    def junk() -> str:
        return r.choice(["", "", f' class="{r.choice(["row", "col", "wrap", "container", "grid", "clearfix", "a1", "inner"])}"'])

    def items(k: int) -> str:
        return "".join(f'<li><a href="/x">{say(1, 4)}</a></li>' for _ in range(k))

    def paras(k: int, lo: int, hi: int, main: bool = False) -> str:
        out = []
        for _ in range(k):
            s = say(lo, hi, main)
            if r.random() < 0.3:
                a = s.split(" ")
                j = r.randint(1, max(1, len(a) - 1))
                tag = r.choice(["b", "em", "a href='/y'", "i"])
                a[j:j] = [f"<{tag}>{_text(r, 1, 3)}</{tag.split()[0]}>"]
                s = " ".join(a)
            out.append(r.choice([f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}", f"<div>{s}</div>"]))
        return "".join(out)

    semantic = r.random() < 0.6
    tag = lambda t: t if semantic and r.random() < 0.85 else "div"

    def wrap(t: str, kind: str, body: str) -> str:
        t = tag(t)
        return f"<{t}{attrs(kind, t == 'div')}>{body}</{t}>"

    nav = lambda: wrap("nav", "nav", f"<ul>{items(r.randint(3, 9))}</ul>" if r.random() < 0.8 else " | ".join(f'<a href="/">{say(1, 2)}</a>' for _ in range(5)))
    ad = lambda: f"<div{attrs('ad', True)}>{say(4, 40) if r.random() < 0.6 else paras(r.randint(1, 2), 5, 60)}</div>"
    head = lambda: wrap("header", "head", f"<{r.choice(['h1', 'div', 'p'])}>{say(1, 5)}" + (nav() if r.random() < 0.5 else ""))
    foot = lambda: wrap("footer", "foot", (f"<ul>{items(4)}</ul>" if r.random() < 0.4 else "") + r.choice([f"&copy; {say(3, 25)}", paras(r.randint(1, 2), 4, 50)]))
    side = lambda: wrap("aside", "side", f"<h3>{say(1, 3)}</h3>" + r.choice([f"<ul>{items(5)}</ul>", paras(2, 5, 50)]))
    notice = lambda: f"<div{attrs('notice', True)}>{r.choice([say(5, 40), paras(1, 5, 50)])}<button>{say(1, 2)}</button></div>"
    form = lambda: f"<form{attrs('form')}><label>{say(1, 6)}</label><input name=q><button>{say(1, 2)}</button></form>" + ("" if r.random() < 0.6 else f"<div{attrs('form', True)}><p>{say(3, 20)}</p><input></div>")
    comment = lambda: f"<{r.choice(['div', 'li', 'article'])}{attrs('comment', True)}>{r.choice(['', f'<b>{say(1, 2)}</b>'])}{paras(r.randint(1, 2), 5, 70)}"

    def comments() -> str:
        t = r.choice(["section", "div", "ol"])
        end = lambda s: s + f"</{s[1 : s.index(' ')]}>"
        return f"<{t}{attrs('comment', True)}><h3>{say(1, 3)}</h3>{''.join(end(comment()) for _ in range(r.randint(1, 5)))}</{t}>"

    def article() -> str:
        out = [f"<h1>{say(2, 10, True)}</h1>"] if r.random() < 0.75 else []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            k = r.random()
            if k < 0.72:
                out.append(paras(1, r.choice([1, 5, 20]), r.choice([20, 60, 140]), True))
            elif k < 0.8:
                out.append(f"<h2>{say(1, 7, True)}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{say(2, 25, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote>{paras(1, 5, 40, True)}</blockquote>")
            elif k < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 6, True)}</td><td>{say(1, 6, True)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.95:
                out.append(f"<pre>{say(3, 30, True)}</pre>")
            else:
                out.append(r.choice([ad, notice, side, form, nav])())
        body = "".join(out)
        for _ in range(r.randint(0, 2)):
            body = f"<div{junk()}>{body}</div>"
        t = r.choice(["article", "article", "main", "div", "section"]) if semantic else "div"
        a = attrs("main", t in ("div", "section")) if r.random() < 0.8 else junk()
        return f"<{t}{a}>{body}{comments() if r.random() < 0.2 else ''}</{t}>"

    top = [x() for x in (head, nav, notice, ad, form) if r.random() < 0.5]
    end = [x() for x in (comments, side, ad, form, notice, foot, nav) if r.random() < 0.45]
    r.shuffle(top)
    middle = article() if r.random() < 0.95 else ""
    if r.random() < 0.3:
        middle = f"<div{junk()}>{middle}{side()}</div>"
    body = "".join(top) + middle + "".join(end)
    if r.random() < 0.4:
        body = f"<div{junk()}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{say(2, 9)}</title><style>p{{}}</style></head><body>{body}<script>var t='</p>';</script></body></html>", marks


@lru_cache(1)
def trained(pages: int = 500, seed: int = 17) -> dict:
    """The model, from `pages` generated pages."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, marks = generated(r)
        p = Page(source)
        y = np.array([t is not None and t.split(" ", 1)[0] in marks for t in p.text])
        for i in range(len(y) - 1, 0, -1):
            y[p.parent[i]] |= y[i]
        xs.append(features(p))
        ys.append(y)
    return fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def main_texts(model: dict, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    odds = predict(model, np.concatenate([features(p) for p in pages])).tolist()
    out, at = [], 0
    for p in pages:
        out.append(" ".join(decode(p, odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


# ---------------------------------------------------------------- Spark


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages (html, more) and `text`, the main text of the whole html.

    Character references are decoded; white space in a block becomes one space; blocks are joined in page order by one
    space. A null or empty html, and one without main text, gives an empty text. Broken markup (unclosed or stray tags)
    is read as browsers do in the common cases. Repeated rows get equal results; further and clashing columns are not
    looked at. Empty table: no rows.
    """
    model = trained()
    n = len(keep)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                source = [s or "" for s in b.column(n).to_pylist()]
                text = [t for a in range(0, len(source), 128) for t in main_texts(model, source[a : a + 128])]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(text, pa.string())], [*b.schema.names[:n], "text"])

    return map_arrow(pages.select(*keep, F.col("html").alias("html__")), run, with_fields(pages, keep, "text string"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
