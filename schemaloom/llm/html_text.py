"""Main text of web pages by boosted trees over DOM nodes.

1. Parse. One pass builds the tree of block elements (an inline element belongs
   to its block), with HTML's implied end tags, in time linear in the page.
   Scripts, styles, titles, comments, drawings and what stands in for media show
   no text and are no nodes; formulas, objects and noscript are like other inline
   elements.
2. Features of a node: its kind, attribute tokens of itself and above it, depth,
   place among its siblings, and subtree density: words, links, tags, blocks.
3. Model. Gradient-boosted trees (boosting.py), fitted on the driver on TRAIN
   generated pages whose labels are known by construction: a node is positive
   if its subtree holds main text.
4. Hierarchical decoding. A node is in or out. Below a node that is out all are
   out, so no descendant contradicts an ancestor; among the labellings that
   obey this, dynamic programming over the tree takes the most likely.
5. Text. The blocks of nodes that are in, in page order: character references
   decoded, white space turned into one space, trimmed, empty ones left out,
   joined by one line feed.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .boosting import Boosted

TRAIN = 500  # generated pages
ADDED = ("text", "n_chars")

# Element kinds of HTML.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
# Elements that show no text of the page: those whose content is raw text, and those that hold elements.
RAW = set("script style iframe title textarea noembed noframes".split())
SKIPPED = RAW | set("template svg canvas audio video datalist annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - set("button label body html option optgroup select td th tr tbody thead tfoot caption legend".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "p": {"button", "td", "th", "table"}}
KINDS = [{"p"}, {"h1"}, set("h2 h3 h4 h5 h6".split()), {"li", "dt", "dd"}, set("ul ol dl menu dir".split()), {"nav"}, {"header", "hgroup"}, {"footer", "address"}, {"aside"}, {"article"}, {"main"}, {"section"}, {"form", "fieldset", "label", "button", "select", "option", "optgroup", "legend"}, set("table tbody thead tfoot tr td th caption".split()), {"blockquote", "pre", "figure", "figcaption"}, {"dialog", "details", "summary"}, {"body", "html"}, {"div", "center"}]
KIND = {t: i for i, tags in enumerate(KINDS) for t in tags}
GOOD = set("article articlebody body content entry main post story text prose maincontent richtext paragraph".split())
BAD = set("ad ads adv advert advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar toolbar comment comments respond reply replies disqus discussion share sharing social related recommended recommendations more newsletter subscribe subscription signup login search form pagination pager copyright legal tags tag meta byline author toc skip print hidden tracking outbrain taboola trending popular".split())

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The rest of a tag: a quote holds a > only where a value begins; any other quote is a character like others.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+""")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDE = re.compile(r"""(?:\shidden(?=[\s/>=]|$))|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED}
_EITHER = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED - RAW}


class _Tags:
    """Tags of a text, in time linear in it: (start, end, is an end tag, name, attributes); no name for markup without one."""

    def __init__(self, text: str):
        self.text, self.at, self.stop = text, 0, text.rfind(">") + 1
        self.unended: set[str] = set()  # elements without an end tag in what is left
        self.loose = False  # a tag ran to the end of the text, so quotes count no more

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        text, size = self.text, len(self.text)
        while (m := _OPEN.search(text, self.at)) is not None:
            start, at = m.start(), m.end()
            if m[1]:
                if empty := re.compile(r"-?>").match(text, at):
                    end = empty.end()
                else:
                    end = text.find("-->", at)
                    end = size if end < 0 else end + 3
                name = rest = ""
            elif m[3]:
                name = m[3].lower()
                end = size if self.loose else _REST.match(text, at).end()
                if end >= size:
                    self.loose = True
                    end = text.find(">", at)
                rest, end = text[at:end], end + 1
            else:
                name, rest, end = "", "", text.find(">", at) + 1
            if not end:  # nothing closes it: what is left is text
                return
            self.at = end
            yield start, end, bool(m[2]), name, rest

    def skip(self, name: str) -> None:
        """Go behind the end of the element that has just begun. Without an end tag raw text goes to the end of the page; of others only the tag is left out."""
        if name in RAW:
            end = _END[name].search(self.text, self.at, self.stop)
            self.at = end.end() if end else len(self.text)
        elif name not in self.unended:
            depth, at = 1, self.at
            while depth and (m := _EITHER[name].search(self.text, at, self.stop)):
                depth, at = depth + (-1 if m[1] else not m[0].endswith("/>")), m.end()
            if depth:
                self.unended.add(name)
            else:
                self.at = at


class Page:
    """The block tree of one page; arrays by node, and pieces of text with their node and block."""

    __slots__ = ("bad", "blocks", "depth", "good", "hidden", "kind", "links", "parent", "tags")

    def __init__(self, text: str):
        self.kind, self.parent, self.depth, self.good, self.bad, self.hidden, self.tags, self.links = [len(KINDS)], [-1], [0], [0], [0], [0], [0], [0]
        self.blocks: list[list] = []  # node, text, words inside links
        self._parse(text)

    def _parse(self, text: str) -> None:
        stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, node (inline elements carry their block's), place of the last block
        places: dict[str, list[int]] = {}  # of each open name, in the stack
        node, fresh, at = 0, True, 0
        blocks = self.blocks

        def push(name: str, its: int) -> None:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, its, len(stack) if name in BLOCK else stack[-1][2]))

        def pop(to: int) -> None:
            while len(stack) > to:
                places[stack.pop()[0]].pop()

        def add(piece: str) -> None:
            nonlocal fresh
            if fresh or not blocks or blocks[-1][0] != node:
                blocks.append([node, [], 0])
                fresh = False
            blocks[-1][1].append(piece)
            if places.get("a"):
                blocks[-1][2] += len(piece.split())

        tags = _Tags(text)
        for start, end, ends, name, rest in tags:
            if start > at:
                add(text[at:start])
            at = end
            if not name:
                continue
            if ends:
                if open_ := places.get(name):
                    i = open_[-1]
                    if name in BLOCK:
                        fresh = True
                    elif stack[-1][2] > i:
                        continue  # an inline end tag does not close blocks
                    pop(i)
                    node = stack[-1][1]
                continue
            if name in SKIPPED:
                if not rest.endswith("/"):
                    tags.skip(name)
                    at = tags.at
                continue
            self.tags[node] += 1
            if name in VOID:
                if name in ("br", "hr") and blocks and not fresh:
                    blocks[-1][1].append(" ")
                fresh = fresh or name == "hr"
                continue
            if name not in BLOCK:
                self.links[node] += name == "a"
                push(name, node)
                continue
            fresh = True
            closes = set(ENDS.get(name, ()))
            if name in CLOSES_P:
                closes.add("p")
            for target in closes:
                if open_ := places.get(target):
                    if open_[-1] > max((places[x][-1] for x in SCOPE.get(target, ()) if places.get(x)), default=0):
                        pop(open_[-1])
            above = stack[-1][1]
            good = bad = hidden = 0
            if rest:
                for x in _ATTR.findall(rest):
                    for value in x:
                        for word in _PART.findall(value):
                            word = word.lower()
                            good += word in GOOD
                            bad += word in BAD
                hidden = int(bool(_HIDE.search(rest)))
            node = len(self.kind)
            self.kind.append(KIND[name])
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.good.append(good)
            self.bad.append(bad)
            self.hidden.append(hidden)
            self.tags.append(0)
            self.links.append(0)
            push(name, node)
        if at < len(text):
            add(text[at:])

    def texts(self) -> list[tuple[int, str, int]]:
        """(node, text, link words) of the blocks that hold text, in page order."""
        out = []
        for node, pieces, links in self.blocks:
            raw = "".join(pieces)
            if "&" in raw:
                raw = html.unescape(raw)
            raw = " ".join(raw.split())
            if raw:
                out.append((node, raw, links))
        return out


def features(page: Page, texts: list[tuple[int, str, int]]) -> np.ndarray:
    """One row per node."""
    n = len(page.kind)
    kind, parent, depth = np.array(page.kind), page.parent, np.array(page.depth, np.float32)
    words, links, chars, stops, blocks = (np.zeros(n) for _ in range(5))
    for node, text, link in texts:
        words[node] += text.count(" ") + 1
        chars[node] += len(text)
        links[node] += link
        stops[node] += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…")
        blocks[node] += 1
    tags, anchors = np.array(page.tags, np.float64), np.array(page.links, np.float64)
    paragraphs = (kind == KIND["p"]).astype(np.float64)
    own = words.copy()
    sub = np.stack((words, chars, links, stops, blocks, tags, anchors, paragraphs), axis=1)
    above = np.zeros((n, 4))  # good and bad tokens, bad kinds, good kinds above the node
    self_ = np.stack((np.array(page.good, np.float64), np.array(page.bad, np.float64), np.isin(kind, [KIND[t] for t in ("nav", "footer", "aside", "form")]) * 1.0, np.isin(kind, [KIND[t] for t in ("article", "main")]) * 1.0), axis=1)
    order, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[int, list[int]] = {}
    for i in range(1, n):
        above[i] = above[parent[i]] + self_[parent[i]]
        seen.setdefault(parent[i], []).append(i)
    for i in range(n - 1, 0, -1):
        sub[parent[i]] += sub[i]
    before, after = np.full(n, -1), np.full(n, -1)
    for kids in seen.values():
        kinds = [page.kind[k] for k in kids]
        alike = Counter(kinds)
        for j, k in enumerate(kids):
            order[k], siblings[k] = j, len(kids)
            same[k] = alike[kinds[j]]
            before[k] = kinds[j - 1] if j else -1
            after[k] = kinds[j + 1] if j + 1 < len(kids) else -1
    total = max(1.0, sub[0, 0])
    w = np.maximum(1.0, sub[:, 0])
    up = np.maximum(np.array(parent), 0)
    cols = [
        *((kind == k) * 1.0 for k in range(len(KINDS))), self_[:, 0], self_[:, 1], above[:, 0], above[:, 1], above[:, 2], above[:, 3], np.array(page.hidden),
        depth, order, siblings, same, before, after, kind[up], np.log1p(own), np.log1p(sub[:, 0]), sub[:, 0] / total, sub[:, 1] / w, sub[:, 2] / w, sub[:, 3] / w, sub[:, 0] / (sub[:, 5] + 1), sub[:, 0] / np.maximum(1, sub[:, 4]),
        sub[:, 6], sub[:, 7], sub[up, 7], sub[up, 2] / np.maximum(1, sub[up, 0]), np.arange(n) / n,
    ]
    return np.stack(cols, axis=1).astype(np.float32)


def decode(parent: list[int], margin: np.ndarray) -> np.ndarray:
    """The most likely labelling without a positive node below a negative one. The root is always in."""
    n = len(parent)
    yes = -np.logaddexp(0, -margin)
    no = -np.logaddexp(0, margin)
    inside, outside = yes.copy(), no.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        inside[p] += max(inside[i], outside[i])
        outside[p] += outside[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[parent[i]] and inside[i] >= outside[i]
    return keep


# ---------------------------------------------------------------- training pages


class _Maker:
    """Generated pages; text marked by \u0001 is main text."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.parts = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 2))) for _ in range(80)]

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        out, r = [], self.r
        for i in range(r.randint(lo, hi)):
            w = "".join(r.choice(self.parts) for _ in range(r.randint(1, 3)))
            if r.random() < 0.08:
                w += r.choice([".", ",", "!", " |", "&amp;", "***"])
            out.append(w.capitalize() if not i or out[-1].endswith(".") else w)
        return " ".join(out) + ("." if stop and r.random() < 0.8 else "")

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 4, False)}</a>'

    def main(self, text: str) -> str:
        return "\u0001" + text

    def some(self, *items: str) -> str:
        return self.r.choice(items)

    def links(self, tag: str, attr: str) -> str:
        r = self.r
        if r.random() < 0.75:
            return f"<{tag}{attr}><ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9))) + f"</ul></{tag}>"
        return f"<{tag}{attr}>" + self.some(" ", " | ", "").join(self.link() for _ in range(r.randint(2, 9))) + f"</{tag}>"

    def junk(self) -> str:
        """A block of boilerplate that stands beside or inside the article."""
        r = self.r
        k = r.randint(0, 10)
        name = lambda *x: self.some(*(f' class="{a}"' for a in x), *(f' id="{a}"' for a in x))
        text = "".join(f"<p>{self.words(3, 30)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.5 else self.words(2, 40)
        if k <= 2:
            return f"<{(t := self.some('div', 'div', 'aside', 'section'))}{name('ad', 'ads', 'advert', 'ad-slot', 'banner-ad', 'sponsored', 'promo')}>{text}</{t}>"
        if k == 3:
            return f"<div{name('cookie-notice', 'notice', 'alert', 'cookie-consent', 'gdpr')}>{text}{self.some('', '<button>OK</button>')}</div>"
        if k == 4:
            return self.links(self.some("aside", "div"), name("sidebar", "related", "related-posts", "widget", "trending"))
        if k == 5:
            return f"<form{self.some('', name('newsletter', 'search', 'subscribe', 'login'))}><label>{self.words(1, 5)}</label><input type=\"text\"><button>{self.words(1, 2, False)}</button>{self.some('', '<p>' + self.words(4, 20) + '</p>')}</form>"
        if k == 6:
            return f"<div{name('share', 'social', 'tags', 'breadcrumbs', 'pagination')}>" + " ".join(self.link() for _ in range(r.randint(2, 5))) + "</div>"
        if k == 7:
            return f"<aside{self.some('', name('sidebar', 'side'))}><h3>{self.words(1, 4, False)}</h3>{text}</aside>"
        if k == 8:
            return self.comments()
        if k == 9:
            return f"<!-- {self.words(2, 5)} -->"
        return f"<script>var a=\"</p><p>{self.words(1, 4)}\";</script>"

    def comments(self) -> str:
        r = self.r
        one = lambda: self.some(f'<div class="{self.some("comment", "reply")}"><p>{self.words(4, 50)}</p></div>', f"<li><b>{self.words(1, 2, False)}</b><p>{self.words(4, 50)}</p></li>", f"<article class=\"comment\"><p>{self.words(4, 50)}</p></article>", f"<p>{self.words(4, 50)}</p>")
        t = self.some("div", "section", "aside", "ol")
        return f"<{t} {self.some('class', 'id')}=\"{self.some('comments', 'comment-list', 'discussion', 'respond', 'user-comments')}\">{self.some('', '<h3>' + self.words(1, 3, False) + '</h3>')}" + "".join(one() for _ in range(r.randint(1, 6))) + f"</{t}>"

    def paragraph(self) -> str:
        r = self.r
        text = self.words(1, 4) if r.random() < 0.15 else self.words(3, 90)
        if r.random() < 0.2:
            words = text.split(" ")
            i = r.randrange(len(words))
            words[i] = self.some(f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f'<a href="/x">{words[i]}</a>', f'<span class="x">{words[i]}</span>')
            text = " ".join(words)
        body = self.main(text)
        return self.some(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p>{body}<br></p>", f'<p class="{self.some("intro", "lead", "text")}">{body}</p>')

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            h = f"<h1>{self.main(self.words(2, 10, False))}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(0 if out else 1, 14)):
            k = r.random()
            if k < 0.72:
                out.append(self.paragraph())
            elif k < 0.8:
                out.append(f"<h{(d := r.randint(2, 4))}>{self.main(self.words(1, 8, False))}</h{d}>")
            elif k < 0.86:
                t = self.some("ul", "ol")
                out.append(f"<{t}>" + "".join(f"<li>{self.main(self.words(2, 25))}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.9:
                out.append(self.some(f"<blockquote><p>{self.main(self.words(5, 40))}</p></blockquote>", f"<blockquote>{self.main(self.words(5, 40))}</blockquote>", f"<pre>{self.main(self.words(5, 40))}</pre>"))
            elif k < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.main(self.words(1, 5, False))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.94:
                out.append(f'<figure><img src="a.png"><figcaption>{self.main(self.words(2, 12))}</figcaption></figure>')
            elif k < 0.97:
                out.append(f"<div>{self.main(self.words(10, 60))}</div>")
            else:
                out.append(self.junk())
        return self.some("", "\n").join(out)

    def page(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.5:
            t = self.some("header", "div")
            body.append(f"<{t}{self.some('', ' class=\"header\"', ' id=\"masthead\"', ' class=\"topbar\"') if t == 'header' else ' class=\"header\"'}>{self.some('<h1>' + self.words(1, 3, False) + '</h1>', '<p>' + self.words(1, 8) + '</p>', self.link())}{self.some('', self.links('nav', ''))}</{t}>")
        if r.random() < 0.75:
            body.append(self.links("nav", self.some("", ' class="menu"')) if r.random() < 0.75 else self.links("div", self.some(' class="menu"', ' id="nav"', ' class="navbar"')))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            body.append(self.junk())
        inner = self.article()
        form = r.randint(0, 9)
        if form <= 3:
            inner = f"<article{self.some('', '', ' class=\"post\"')}>{inner}</article>"
        elif form == 4:
            inner = f"<main>{inner}</main>"
        elif form == 5:
            inner = f"<main><article>{inner}</article>{self.some('', self.junk())}</main>"
        elif form <= 7:
            inner = f"<div {self.some('class', 'id')}=\"{self.some('content', 'post', 'entry-content', 'article-body', 'story', 'main')}\">{inner}</div>"
        elif form == 8:
            inner = f"<div class=\"{self.some('wrap', 'container', 'c1')}\"><div>{inner}</div>{self.some('', self.junk())}</div>"
        body.append(inner)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            body.append(self.junk())
        if r.random() < 0.3:
            body.append(self.comments())
        if r.random() < 0.85:
            text = self.some(f"&copy; {self.words(1, 4)} &middot; {self.words(3, 20)}", f"<p>{self.words(3, 20)}</p>", self.links("div", ""), f"<p>&copy; {self.words(2, 8)}</p>{self.links('div', '')}")
            body.append(self.some(f"<footer>{text}</footer>", f"<footer>{text}</footer>", f"<div {self.some('class', 'id')}=\"footer\">{text}</div>"))
        if r.random() < 0.3:
            body = [f"<div id=\"{self.some('page', 'wrapper', 'root')}\">", *body, "</div>"]
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body>{self.some('', chr(10)).join(body)}{self.some('</body></html>', '')}"


def training_pages(n: int = TRAIN, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a generated page that hold text."""
    marked = Page(page)
    label = np.zeros(len(marked.kind))
    for node, text, _ in marked.texts():
        if "\u0001" in text:
            while node >= 0 and not label[node]:
                label[node] = 1
                node = marked.parent[node]
    plain = Page(page.replace("\u0001", ""))
    x = features(plain, plain.texts())
    held = np.expm1(x[:, FEATURE_WORDS]) > 0
    held[0] = False
    return x[held], label[held]


FEATURE_WORDS = len(KINDS) + 15  # the column with the words of the subtree


@functools.cache
def model() -> Boosted:
    """Fitted once per driver, on generated pages only."""
    x, y = zip(*(labelled(p) for p in training_pages()))
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: list[str], trees: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [Page(p) for p in pages]
    texts = [p.texts() for p in parsed]
    rows = [features(p, t) for p, t in zip(parsed, texts)]
    margin = trees.margin(np.concatenate(rows)) if rows else np.zeros(0)
    at, out = 0, []
    for page, text in zip(parsed, texts):
        n = len(page.kind)
        m = margin[at : at + n].copy()
        at += n
        words = np.zeros(n, bool)
        for node, _, _ in text:
            while node >= 0 and not words[node]:
                words[node] = True
                node = page.parent[node]
        m[~words] = 0  # a node without text decides nothing
        keep = decode(page.parent, m)
        out.append("\n".join(t for node, t, _ in text if keep[node]))
    return out


def _extract(html_at: int, trees: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in c.blocks(batch.column(html_at)):
                raw = data.tobytes()
                texts = extract([raw[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:])], trees)
                part = batch.slice(lo, hi - lo)
                part = pa.RecordBatch.from_arrays([x for i, x in enumerate(part.columns) if i != html_at], names=[x for i, x in enumerate(part.schema.names) if i != html_at])
                yield c.with_arrays(part, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return run


def extract_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df's columns without the html, with text and n_chars (its code points).

    A null or empty html, or a page without main text, gives an empty text.
    Rows are independent, so ties and repeated rows need nothing; input columns
    named text or n_chars are replaced; an empty table gives an empty table.
    """
    df = c.without(df, *ADDED)
    df = df.withColumn(html_col, F.col(html_col).cast("string"))
    at = df.columns.index(html_col)
    schema = T.StructType([f for i, f in enumerate(c.schema_of(df, ("text", T.StringType()), ("n_chars", T.LongType())).fields) if i != at])
    return df.mapInArrow(_extract(at, model()), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """The op5 query over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
