"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no ancestor contradicts a descendant."""

from __future__ import annotations

import html
import pickle
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
END_OR_QUOTE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select option button noembed".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation".split()
)
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "menu", "body", "html"}
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote figure pre #block".split()
#: Attribute words are features by hash, of a node and of its parent, besides the counts of two lists.
TOKEN_BUCKETS = 32
GOOD = set("article body content entry main post story text prose read hentry markdown articlebody copy paragraph".split())
BAD = set(
    "ad ads advert advertisement adslot alert aside author banner bar bottom breadcrumb breadcrumbs button comment comments consent cookie cookies copyright credits disclaimer discussion disqus footer foot form gdpr head "
    "header hidden legal links login masthead menu meta modal nav navbar navigation navigationbar newsletter notice notification overlay pager pagination popular popup promo promotion reader recommended related replies reply search share sharing "
    "sidebar signup site skip social sponsor sponsored subscribe subscription tags toolbar top topbar trending widget".split()
)


def tag_end(source: str, at: int, broken: set[int]) -> int:
    """The place of the > that ends a tag, which must have one after at: the first outside quotes, or the first of all where a quote isn't closed.

    broken keeps the opening quotes of tries that led nowhere, so no later one goes the same way again and all of them
    together take time in proportion to the page.
    """
    i, passed = at, []
    while (m := END_OR_QUOTE.search(source, i)) is not None:
        if m[0] == ">":
            return m.start()
        passed.append(m.start())
        i = -1 if m.start() in broken else source.find(m[0], m.end())
        if i < 0:
            break
        i += 1
    broken.update(passed)
    return source.find(">", at)


class Page:
    """The block elements of a page as a tree. An element with one block of text and nothing else holds it, other blocks are leaves of their own."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.good, self.bad = [-1], ["html"], [0], [0]
        self.tokens: list[int] = [0]  # a bit for every bucket of TOKEN_BUCKETS that an attribute word falls into
        self.text: list[str] = [""]
        self.links: list[int] = [0]
        self._kids: list[int] = [0]
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._open: dict[str, list[int]] = {"html": [0]}  # places in the stack by tag, so that no look-up walks it
        self._scopes: list[int] = [0]
        self._buffer: list[str] = []
        self._linked = 0
        self._in_link = 0
        self._read(source)

    def _node(self, tag: str, attrs: str = "") -> int:
        good = bad = bits = 0
        if attrs:
            for value in ATTRIBUTE.findall(attrs):
                words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                good += len(words & GOOD)
                bad += len(words & BAD)
                for w in words:
                    bits |= 1 << zlib.crc32(w.encode()) % TOKEN_BUCKETS
        self.parent.append(self._stack[-1][1])
        self._kids[self._stack[-1][1]] += 1
        self._kids.append(0)
        self.tag.append(tag)
        self.good.append(good)
        self.bad.append(bad)
        self.tokens.append(bits)
        self.text.append("")
        self.links.append(0)
        return len(self.tag) - 1

    def _flush(self, closing: bool = False) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            self._buffer = []
            if text:
                top = self._stack[-1][1]
                at = top if closing and top and not self._kids[top] else self._node("#block")
                self.text[at] = text
                self.links[at] = min(self._linked, len(text))
            self._linked = 0

    def _say(self, text: str) -> None:
        self._buffer.append(text)
        if self._in_link:
            self._linked += len(text)

    def _pop(self, upto: int) -> None:
        self._flush(closing=True)
        while len(self._stack) > upto:
            tag, _ = self._stack.pop()
            self._open[tag].pop()
            if tag in SCOPE:
                self._scopes.pop()

    def _push(self, tag: str, attrs: str) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append((tag, self._node(tag, attrs)))

    def _last(self, tags: set[str]) -> int:
        """The innermost place in the stack of any of the tags; 0 where none is open."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _declaration(self, source: str, lt: int) -> int:
        """The place after a comment, a CDATA section, which is text, or another declaration."""
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
            if source.startswith(start, lt):
                close = source.find(stop, lt + len(start))
                if start == "<![CDATA[":
                    self._say(html.escape(source[lt + 9 : close if close >= 0 else len(source)]))
                if close < 0 and start == "<":  # ends nowhere: no text either
                    return len(source)
                return len(source) if close < 0 else close + len(stop)
        return lt + 1

    def _read(self, source: str) -> None:
        at, end, last = 0, len(source), source.rfind(">")
        unclosed: set[str] = set()
        broken: set[int] = set()
        while at < end:
            lt = source.find("<", at)
            if lt < 0 or lt + 1 == end:
                self._say(source[at:])
                break
            if lt > at:
                self._say(source[at:lt])
            if source[lt + 1] in "!?":
                at = self._declaration(source, lt)
                continue
            m = NAME.match(source, lt) if lt < last else None
            if m is None:  # a bare <, or a tag that nothing closes any more
                at = lt + 1 if lt < last else end
                self._say(source[lt:at])
                continue
            close = tag_end(source, m.end(), broken)
            closing, tag, attrs, at = bool(m[1]), m[2].lower(), source[m.end() : close], close + 1
            if tag in RAW or tag == "xmp":
                if not closing and not attrs.endswith("/") and tag not in unclosed:
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at, last + 1)
                    if tag == "xmp":  # text as it is written
                        self._flush()
                        self._say(html.escape(source[at : close.start() if close else end]))
                        self._flush()
                    if not close:
                        unclosed.add(tag)  # nor is there one further on
                    at = close.end() if close else (end if tag in ("script", "style", "xmp") else at)
                continue
            if tag in INLINE:
                if tag == "a":
                    self._in_link = 0 if closing else 1
                if tag == "br" or tag == "img":
                    self._say(" ")
                continue
            if tag in VOID:
                self._flush()
                continue
            self._in_link = 0 if tag in CLOSES_P else self._in_link
            if closing:
                if (i := self._last({tag})) > 0:
                    self._pop(i)
                else:
                    self._flush()
                continue
            self._flush()
            if tag in CLOSES_P and self._stack[-1][0] == "p":
                self._pop(len(self._stack) - 1)
            if tag in ALIKE and (i := self._last(ALIKE[tag])) > self._scopes[-1]:
                self._pop(i)
            if tag != "html":
                self._push(tag, attrs)
        self._flush()

    def features(self) -> np.ndarray:
        """A row per node: tag, attribute tokens (own, and of ancestors), depth, subtree size, density and links, siblings, place."""
        n = len(self.tag)
        chars, links, nodes, blocks, commas, kids, depth = (np.zeros(n) for _ in range(7))
        up = np.array(self.parent)
        own = np.fromiter(map(len, self.text), dtype=float, count=n)
        chars += own
        links += np.array(self.links, dtype=float)
        commas += np.fromiter((sum(map(t.count, ".,;:!?")) for t in self.text), dtype=float, count=n)
        blocks += own > 0
        nodes += 1
        rank, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n)
        titles = np.array([t == "h1" for t in self.tag], dtype=float)
        inherit = np.zeros((n, 5))
        roles = [{"article": 0, "main": 0, "nav": 1, "menu": 1, "footer": 2, "header": 2, "aside": 3, "form": 4}.get(t, -1) for t in self.tag]
        good, bad = np.array(self.good, dtype=float), np.array(self.bad, dtype=float)
        good_up, bad_up = np.zeros(n), np.zeros(n)
        seen: dict[tuple[int, str], int] = {}
        for i in range(1, n):  # parents come before their children
            p = self.parent[i]
            depth[i] = depth[p] + 1
            rank[i] = kids[p]
            kids[p] += 1
            inherit[i] = inherit[p]
            if roles[i] >= 0:
                inherit[i, roles[i]] = 1
            good_up[i], bad_up[i] = good_up[p] + good[p], bad_up[p] + bad[p]
            key = (p, self.tag[i])
            seen[key] = seen.get(key, 0) + 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            commas[p] += commas[i]
            blocks[p] += blocks[i]
            nodes[p] += nodes[i]
            titles[p] += titles[i]
            siblings[i] = kids[p]
            same[i] = seen[p, self.tag[i]]
        total = max(1.0, chars[0])
        start = np.concatenate(([0], np.cumsum(own)[:-1]))
        upx = np.maximum(up, 0)
        kind = [TAGS.index(t) if t in TAGS else len(TAGS) for t in self.tag]
        cols = [
            np.array(kind, dtype=float), np.array(kind, dtype=float)[upx], good, bad, good[upx], bad[upx], good_up, bad_up, *inherit.T, depth, kids, np.log1p(nodes), np.log1p(chars), np.log1p(own),
            chars / (nodes + 1), links / np.maximum(1, chars), commas / np.maximum(1, chars), chars / np.maximum(1, blocks), chars / total, start / total, rank / np.maximum(1, siblings), siblings, same,
            chars / np.maximum(1, chars[upx]), links[upx] / np.maximum(1, chars[upx]), titles, np.full(n, titles[0]), titles[upx],
        ]
        bits = np.array(self.tokens, dtype=np.int64)[:, None] >> np.arange(TOKEN_BUCKETS) & 1
        return np.concatenate((np.stack(cols, 1), bits, bits[upx]), 1)

    def decode(self, p: np.ndarray) -> str:
        """The text of kept leaves under the likeliest labelling in which a node that is left out leaves out all below it."""
        n = len(self.tag)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        log_in, log_out = np.log(p).tolist(), np.log1p(-p).tolist()
        kept, dropped = log_in[:], log_out[:]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            kept[up] += max(kept[i], dropped[i])
            dropped[up] += dropped[i]
        stays = [True] * n
        for i in range(1, n):
            stays[i] = stays[self.parent[i]] and kept[i] > dropped[i]
        return "\n".join(t for t, s in zip(self.text, stays) if s and t)


class Trees:
    """Gradient-boosted regression trees for log loss, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        two = np.flatnonzero(((x == 0) | (x == 1)).all(0))  # yes or no, the tokens: one cut, and sums by a product
        yes = x[:, two].astype(np.float32)
        many = [j for j in range(m) if j not in set(two.tolist())]
        self.edges = [np.array([0.5]) if j in set(two.tolist()) else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(m)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        size = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                low, width = 2**level - 1, 2**level
                live = at >= low
                best = np.full(width, 1e-3)
                choice = np.full((width, 2), -1)
                here = (at[None, :] - low == np.arange(width)[:, None]).astype(np.float32)
                gt, ht = here @ g, here @ h
                gr, hr = (here * g.astype(np.float32)) @ yes, (here * h.astype(np.float32)) @ yes
                gl, hl = gt[:, None] - gr, ht[:, None] - hr
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gt**2 / (ht + 1))[:, None]
                gain[(hl < self.least / 10) | (hr < self.least / 10)] = 0
                if len(two):
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    choice[better] = np.stack([two[top], np.zeros(width, dtype=np.int64)], 1)[better]
                for j in many:
                    key = (at[live] - low) * self.bins + binned[live, j]
                    gs = np.bincount(key, g[live], width * self.bins).reshape(width, self.bins).cumsum(1)
                    hs = np.bincount(key, h[live], width * self.bins).reshape(width, self.bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 10) | (ht - hs < self.least / 10)] = 0
                    top = gain[:, :-1].argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    choice[better] = np.stack([np.full(width, j), top], 1)[better]
                for k in range(width):
                    j, b = choice[k]
                    if j >= 0 and b < len(self.edges[j]):
                        feature[low + k], cut[low + k] = j, self.edges[j][b]
                node = np.flatnonzero(live & (feature[at] >= 0))
                right = x[node, feature[at[node]]] >= cut[at[node]]
                at[node] = 2 * at[node] + 1 + right
            gs, hs = np.bincount(at, g, size), np.bincount(at, h, size)
            value = self.rate * gs / (hs + 1)
            f += value[at]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j >= 0, 2 * at + 1 + (x[rows, np.maximum(j, 0)] >= cut[at]), at)
            f += value[at]
        return 1 / (1 + np.exp(-f))


MARK = "\ue000"


def training_page(rng: random.Random, varied: bool = False) -> str:
    """A page of a random layout; blocks of its main text start with MARK.

    Of varied pages one in four has class names that say nothing. The wrapper of the article and the body carry layout
    words too (share-enabled, has-comments), headings stand outside the article, headers inside it, short
    pages have no wrapper at all, and reader comments no name that gives them away: no word decides alone.
    """
    plain = rng.random() < (0.25 if varied else 0.1)
    layout = sorted(BAD)

    def decorated() -> str:
        w = rng.choice(layout)
        return rng.choice((w, w, f"{w}-left", f"has-{w}", f"{w}-enabled", f"tag-{w}", f"with-{w}"))

    def layout_words(most: int) -> str:
        return " ".join(decorated() for _ in range(rng.randint(1, most)))

    def words(a: int, b: int) -> str:
        out = ["".join(rng.choice(("an", "to", "re", "li", "es", "on", "ka", "mur", "vel", "sti")) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(a, b))]
        return " ".join(out).capitalize() + "."

    def element(names: list[str], body: str) -> str:
        name = rng.choice(names)
        tag, _, cls = name.partition(".")
        if plain and cls and tag == "div":  # a page whose class names say nothing
            cls = "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        attr = "" if not cls else rng.choice((f' class="{cls}"', f' id="{cls}"', f' class="{rng.choice(("c", "box", "wrap"))} {cls}"'))
        return f"<{tag}{attr}>{body}</{tag}>"

    def unnamed() -> str:
        return rng.choice(("div", "div", f"div.{''.join(rng.choice('bcdfghklmnpqrstvwz') for _ in range(rng.randint(1, 4)))}", "section", "div.c", "div.x1"))

    def menu(k: int) -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 2)[:-1]}</a></li>' for i in range(k))
        return rng.choice((f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " ")))

    def paragraph(mark: str) -> str:
        body = mark + words(3, rng.choice((12, 60, 160)))
        form = rng.random()
        if form < 0.15:
            return f"<p><b>{body}<br>"
        if form < 0.3:
            return f"<p>{body} <a href='x'>{words(1, 5)}</a> {words(2, 20)}</p>"
        return f"<p>{body}</p>"

    ads = ["div.ad", "div.ads", "div.advert", "aside.promo", "div.banner", "div.sponsored", "section.promo"]
    side = ["aside", "div.sidebar", "aside.sidebar", "div.related", "section.related", "div.widget"]
    before = [
        element(["nav", "div.menu", "div.nav", "nav.navbar", "ul.navigation"], menu(rng.randint(2, 9))), element(["header", "div.header", "div.masthead", "header.top"], rng.choice((f"<h1>{words(1, 4)}</h1>", "")) + f"<p>{words(2, 8)}</p>"),
        element(["div.cookie", "div.notice", "div.alert", "section.consent"], rng.choice((words(4, 30), f"<p>{words(4, 30)}</p>"))), element(ads, rng.choice((words(2, 40), f"<p>{words(2, 40)}</p>"))),
        element(["form.search", "div.login"], f"<label>{words(1, 2)}</label><p>{words(2, 8)}</p><input name=q>"), element(["div.breadcrumb", "nav.breadcrumbs"], menu(3)),
    ]
    after = [
        element(["footer", "div.footer", "footer.site", "div.copyright"], rng.choice((f"&copy; {words(2, 30)}", f"<p>&copy; {words(2, 30)}</p>{menu(3)}", f"&copy; {words(1, 3)} &middot; {words(3, 20)}"))),
        element(["section.comments", "div.comments", "div.replies", "ol.comment", "div.discussion"], f"<h3>{words(1, 2)}</h3>" + "".join(rng.choice((f"<div class='comment'><p>{words(4, 60)}</p></div>", f"<article class='comment'><p>{words(4, 60)}</p></article>", f"<p>{words(4, 60)}</p>")) for _ in range(rng.randint(1, 6)))),
        element(side, f"<h3>{words(1, 3)}</h3>" + rng.choice((menu(5), f"<p>{words(5, 40)}</p>"))), element(["form", "div.newsletter", "form.subscribe"], f"<p>{words(3, 20)}</p><input>"), element(ads, words(3, 40)), element(["div.share", "div.social"], menu(3)),
    ]
    rng.shuffle(before)
    rng.shuffle(after)
    heading = f"<h1>{MARK}{words(2, 12)}</h1>" if rng.random() < 0.9 else ""
    byline = f"<p>{words(1, 4)}</p>" if rng.random() < 0.7 else f"<span>{words(1, 3)}</span><time>{words(1, 2)}</time>"
    outside = varied and rng.random() < 0.3
    if varied and heading and not outside and rng.random() < 0.15:
        heading = f"<header>{heading}{byline}</header>"
    body = [heading] if heading and not outside else []
    n_parts = rng.choice((1, 2, 3, 4, 8, 16, 30))
    for _ in range(n_parts):
        form = rng.random()
        if varied and rng.random() < 0.12:
            said = f"{MARK}{words(2, 30)}"
            body.append(element([unnamed()], rng.choice((said, f"<p>{said}</p>"))))
        elif form < 0.8 or n_parts < 3:
            body.append(paragraph(MARK))
        elif form < 0.86:
            body.append(f"<h2>{MARK}{words(1, 8)}</h2>")
        elif form < 0.9:
            body.append("<ul>" + "".join(f"<li>{MARK}{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif form < 0.93:
            body.append(f"<blockquote><p>{MARK}{words(5, 40)}</p></blockquote>")
        elif form < 0.96:
            body.append(f"<table><tr><td>{MARK}{words(1, 6)}</td><td>{MARK}{words(1, 6)}</td></tr></table>")
        else:
            body.append(element(ads + ["div.share", "aside", "div.newsletter", "nav.menu"], rng.choice((words(2, 30), f"<p>{words(2, 30)}</p>"))))
    if varied and rng.random() < 0.1:
        body.append(element(["footer", "footer.meta"], f"<p>{words(1, 8)}</p>"))
    form = rng.random() if varied else 1.0
    if form < 0.1:  # no wrapper at all
        main = "".join(body)
    elif form < 0.25:
        main = element([unnamed()], "".join(body))
    else:
        main = element(["article", "article", "main", "div.content", "div.post", "div.entry", "section.article", "div.story", "div.main", "article.hentry"], "".join(body))
        if varied and rng.random() < 0.45:
            said = layout_words(3)
            main = re.sub(r"^<(\w+)(?: (class|id)=\"([^\"]*)\")?", lambda m: f'<{m[1]} class="{(m[3] + " ") if m[3] and rng.random() < 0.6 else ""}{said}"', main, count=1)
    if outside and heading:
        main = rng.choice((heading, f"<div>{heading}</div>", f"<div class='{unnamed()[-2:]}'>{heading}</div>")) + main
    if rng.random() < 0.3:
        main = element(["div", "div.container", "main", "div.page", unnamed()], main)
    if varied and rng.random() < 0.08:  # nothing but the text
        return f"<html><body>{''.join(body[:rng.randint(1, 3)]).replace('<header>', '').replace('</header>', '').replace(byline, '') if rng.random() < 0.7 else main}</body></html>"
    if varied and rng.random() < 0.15:  # readers' words under a name that says nothing
        said = "".join(element([unnamed()], f"<p>{words(1, 2)}</p><p>{words(2, 25)}</p>" if rng.random() < 0.4 else f"<p>{words(2, 25)}</p>") for _ in range(rng.randint(1, 5)))
        after.insert(0, element([unnamed()], said) if rng.random() < 0.6 else said)
        after[:] = after[: rng.randint(1, 6)]
    html_ = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{f' class="{layout_words(4)}"' if varied and rng.random() < 0.4 else ""}>" + "".join(before[: rng.randint(0, 5)]) + main + "".join(after[: rng.randint(0, 5)])
    return html_ + rng.choice(("</body></html>", ""))


def fit_extractor(pages: int = 600, seed: int = 5) -> bytes:
    """Trees trained on pages of random layouts: a node counts as main if main text is in it. The size is a parameter; the same seed gives the same trees."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(training_page(rng, varied=True))
        y = np.array([MARK in t for t in page.text])
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] |= y[i]
        xs.append(page.features())
        ys.append(y)
    return pickle.dumps(Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float)))


def extract(sources: list[str], trees: Trees) -> list[str]:
    """Main text of each page; all pages' nodes go through the trees together."""
    parsed = [Page(s) for s in sources]
    if not parsed:
        return []
    rows = [p.features() for p in parsed]
    bounds = np.cumsum([0, *map(len, rows)])
    scores = trees.predict(np.concatenate(rows))
    return [p.decode(scores[a:b]) for p, a, b in zip(parsed, bounds[:-1], bounds[1:])]


def main_text(pages: DataFrame, model: bytes | None = None) -> DataFrame:
    """pages without html, with _main added: the main text of the whole html, '' where there is none (null and empty pages too)."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit_extractor())
    lean = pages.drop("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(held.value)
        for batch in batches:
            for part in common.slices(batch, "_bytes", common.SLICE_BYTES // 2):
                texts = extract([t.decode(errors="replace") for t in common.texts_of(part, "_bytes")], trees)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], names=["_row", "_main"])

    found = pages.select(common.packed(lean), F.col("html").cast("binary").alias("_bytes")).mapInArrow(run, f"{common.row_type(lean)}, _main string")
    return found.select(*common.unpacked(found, "_main"))


def op8_main_text(pages: DataFrame) -> DataFrame:
    """Contract 8: the main text of every page and its length in code points.

    A null or empty html, and a page without main text, give '' and 0. page_id and url may be
    null; repeated rows get a row each. Elements may nest to any depth, and attributes, raw
    elements and texts have any length; broken markup is read on as browsers do. An empty
    table gives an empty result.
    """
    found = main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))
