"""Main text of web pages by composite text density.

A page is read into a tree (arrays of parents and counts; raw elements, comments
and void elements aside, with HTML's implied end tags) in one pass. Parts that say what they are
by tag, role or name (navigation, footers, asides, forms, adverts, reader comments) leave first; a name says so if all of its words do, or
only name a container (``comment-list``, not ``comment-on-law``), and names that an article's own parts may have
(legal, discussion, notice) count only outside of one. Every node then
has the composite text density C/T log_b(C/LC T/LT), with b = ln(C/(C - LC) LC + LCbody/Cbody C + e): characters per tag, lowered
where the characters are in links; counts under one are one, and ln b is ``LEAST_LOG`` at least, for it is nothing where a page has no links.
A node's density sum adds its children's densities; the node
with the largest is the main one, and the least density on its path to the body
is the threshold by which parts beside that path are text too. Inside the main node, lists of links and parts of which only one word of the name
points elsewhere are doubtful: they stay if they stand in an ``article`` or between pieces of text that are not.

White space inside a block becomes one space, blocks are joined by one space.

Edge cases: null and empty pages, and pages without text, give the empty string; broken markup
is read as far as it goes; quotes hide the end of a tag unless they hide all ends up to that of the page, which is known for all places after one look back, so the time stays in proportion to
the page, however long; of nodes with equal sums the denser, then the first is the main one; null ids and urls pass through; repeated rows stay; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|object|canvas|audio|video|select|xmp|noframes"
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+", re.S)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
#: Formatting is no node of its own in the counts.
_FORMAT = _INLINE - {"a"}
#: A start tag closes an open element of these names, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_SCOPE = {"body", "table", "td", "th", "button", "object", "ul", "ol", "li", "div", "section", "article", "main", "aside", "nav", "header", "footer", "blockquote", "form", "figure", "dl", "fieldset"}
_OUT = {"nav", "footer", "aside", "form", "button", "dialog", "fieldset"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Words of a class or id that name a part which is not the article.
_OUT_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar sidebar
    footer copyright cookie cookies consent gdpr alert popup modal comment comments disqus respond reply replies
    related recommended recommendations share sharing social newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager toolbar masthead""".split())
#: The same, but the article may have such parts too: inside it they do not count.
_OUTSIDE_WORDS = set("legal notice notices discussion response responses banner side widget widgets overlay skip".split())
#: Words that only name a container, or the whole of which something is a part.
_NEUTRAL_WORDS = set("""area article articles author bar block body bottom box btn button buttons col column container content count entry form group head header heading icon icons id info inner item items
    js left link links list main message meta news outer page panel popular post posts primary right row secondary section site slot stories sub text thread title top unit wrap wrapper""".split())
#: The logarithm's base is ln(...) of the formula, and tends to 1 where a page has no links: its own logarithm is held over this.
LEAST_LOG = 0.1
_QUOTES = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)


#: What tag and attributes say of a part: nothing, doubt, or that it is not the article.
_SAYS_NOTHING, _DOUBTFUL, _ELSEWHERE = 0, 1, 2


def _named(value: str, in_article: bool) -> int:
    """What a class or an id says, name by name."""
    out = _SAYS_NOTHING
    for name in value.split():
        words = {w.lower() for w in re.split(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])", name)} - {""}
        hits = words & _OUT_WORDS or not in_article and words & _OUTSIDE_WORDS
        if not hits and "header" in words and not in_article and not words & {"article", "post", "entry"}:
            hits = {"header"}
        if hits:
            if words <= _OUT_WORDS | _OUTSIDE_WORDS | _NEUTRAL_WORDS:
                return _ELSEWHERE
            out = _DOUBTFUL
    return out


def _boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    if tag in _OUT or tag == "header" and not in_article:
        return _ELSEWHERE
    if not attrs or tag in ("html", "body", "main", "article"):
        return _SAYS_NOTHING
    out = _SAYS_NOTHING
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            out = max(out, _named(value, in_article))
        elif name == "role" and value.lower() in _OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or tag == "label" and name == "for":
            return _ELSEWHERE
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return _ELSEWHERE
    return out


def _open_ends(html: str, at: int) -> dict[int, int]:
    """For each ``>`` and quote from ``at`` on: the first ``>`` from there that no quote hides, -1 if there is none.

    Read backwards, with the answer for a reader outside of quotes, in double and in single ones.
    """
    ends: dict[int, int] = {}
    out = double = single = -1
    for m in reversed(list(_QUOTES.finditer(html, at))):
        sign = m[0]
        if sign == ">":
            out = m.start()
        elif sign == '"':
            out, double = double, out
        else:
            out, single = single, out
        ends[m.start()] = out
    return ends


def tokens(html: str):
    """(start, end, whether an end tag, name, attributes) of each piece of markup, in one pass; the name is None for comments and raw elements."""
    at, ends, last = 0, None, html.rfind(">")
    while (i := html.find("<", at)) >= 0:
        if html.startswith("<!--", i):
            e = html.find("-->", i + 4)
            at = len(html) if e < 0 else e + 3
            yield i, at, False, None, ""
            continue
        if i > last:
            return
        m = _NAME.match(html, i)
        if not m:
            at = i + 1
            if html[at : at + 1] in ("!", "?", "/"):
                at = html.index(">", at) + 1
                yield i, at, False, None, ""
            continue
        if ends is None:
            e = _ATTRS.match(html, m.end()).end()
            if html[e : e + 1] != ">":  # a quote that never closes: from here on the ends are looked up
                ends = _open_ends(html, m.end())
        if ends is not None:
            sign = _QUOTES.search(html, m.end())
            e = ends[sign.start()] if sign else -1
        if e < 0 and (e := html.find(">", m.end())) < 0:
            return
        at, name = e + 1, m[2].lower()
        if not m[1] and name in _RAW_END:
            close = _RAW_END[name].search(html, at)
            at = close.end() if close else len(html)
            yield i, at, False, None, ""
        else:
            yield i, at, bool(m[1]), name, html[m.end() : e]


class Page:
    """The tree: parent, tag, count of characters, tags, link characters and link tags of each node, and its pieces of text."""

    def __init__(self, html: str):
        self.parent, self.tag, self.out = [-1], ["#root"], [False]
        self.doubtful, self.in_article = [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (node, text), or (node, None) for the border of a block
        stack, open_ = [0], {"#root": 1}
        at, article = 0, 0

        def pop() -> None:
            nonlocal article
            t = self.tag[stack.pop()]
            open_[t] -= 1
            article -= t in ("article", "main")
            if t not in _INLINE:
                self.pieces.append((stack[-1], None))

        def text(s: str) -> None:
            if s:
                self.pieces.append((stack[-1], unescape(s) if "&" in s else s))

        for start, stop, end, tag, attrs in tokens(html):
            text(html[at:start])
            at = stop
            if not tag:
                continue
            if tag in ("html", "body") and (end or open_.get(tag)):
                continue
            if end:
                if not open_.get(tag):
                    continue
                if tag in _INLINE:  # does not reach over the border of a block
                    k = len(stack) - 1
                    while self.tag[stack[k]] in _INLINE and self.tag[stack[k]] != tag:
                        k -= 1
                    if self.tag[stack[k]] != tag:
                        continue
                while self.tag[stack[-1]] != tag:
                    pop()
                pop()
                continue
            if tag == "br" or tag == "hr":
                self.pieces.append((stack[-1], None))
                continue
            if tag in _VOID:
                continue
            if tag == "body" and open_.get("head"):
                while self.tag[stack[-1]] != "head":
                    pop()
                pop()
            names, stop = _CLOSES.get(tag, (None, None))
            if names is None and tag not in _INLINE and open_.get("p"):
                names, stop = {"p"}, _SCOPE
            if names and any(open_.get(x) for x in names):
                k = len(stack) - 1
                while k and self.tag[stack[k]] not in stop and self.tag[stack[k]] not in names:
                    k -= 1
                if self.tag[stack[k]] in names:
                    if tag == "tr" or tag in ("tbody", "tfoot"):  # a row closes its cells and the row before
                        while k and self.tag[stack[k - 1]] in names:
                            k -= 1
                    while len(stack) > k:
                        pop()
            if tag not in _INLINE:
                self.pieces.append((stack[-1], None))
            node = len(self.parent)
            up = stack[-1]
            self.parent.append(up)
            self.tag.append(tag)
            says = _boilerplate(tag, attrs, article > 0)
            self.out.append(self.out[up] or tag == "head" or says == _ELSEWHERE)
            self.doubtful.append(says == _DOUBTFUL)
            self.in_article.append(self.in_article[up] or tag == "article")
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
            article += tag in ("article", "main")
        text(html[at:])

    def counts(self):
        """chars, tags, link chars, link tags below and at each node, without what is out."""
        n = len(self.parent)
        chars, tags, link, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
            if not self.out[i]:
                tags[i] = int(self.tag[i] not in _FORMAT)
                links[i] = int(self.tag[i] == "a")
        for i, s in self.pieces:
            if s and not self.out[i]:
                c = len("".join(s.split()))
                chars[i] += c
                if in_link[i]:
                    link[i] += c
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i]
            link[p] += link[i]
            links[p] += links[i]
        return chars, tags, link, links

    def densities(self, chars, tags, link, links) -> list[float]:
        body = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        ratio = link[body] / max(chars[body], 1)
        out = []
        for c, t, lc, lt in zip(chars, tags, link, links, strict=True):
            if not c:
                out.append(0.0)
                continue
            base = log(log(c / max(c - lc, 1) * lc + ratio * c + e))
            arg = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            out.append(c / max(t, 1) * log(max(arg, 1.0)) / max(base, LEAST_LOG))
        return out

    def select(self) -> list[bool]:
        """Which nodes hold text of the article."""
        chars, tags, link, links = self.counts()
        n = len(self.parent)
        d = self.densities(chars, tags, link, links)
        sums = [0.0] * n
        for i in range(1, n):
            if self.tag[i] not in _FORMAT:
                sums[self.parent[i]] += d[i]
        for i in range(n):  # a node without others stands for itself
            sums[i] = 0.0 if self.tag[i] in _FORMAT else sums[i] or d[i]
        best = max(range(n), key=lambda i: (sums[i], d[i], -i))
        if not chars[0]:
            return [False] * n
        path, i = set(), best
        threshold = d[best]
        while i >= 0:
            path.add(i)
            if self.tag[i] not in ("#root", "html"):
                threshold = min(threshold, d[i])
            if self.tag[i] == "body":
                break
            i = self.parent[i]
        keep, doubt = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            if self.out[i]:
                continue
            if i == best or p >= 0 and keep[p]:
                keep[i] = True
            elif i in path:
                continue
            elif p in path and (d[i] >= threshold and d[i] > 0 or self.tag[i] in ("h1", "h2", "h3") and self._beside(i, best)):
                keep[i] = True
            if i not in path and not self.in_article[i]:
                of_links = self.tag[i] in ("ul", "ol", "div", "section", "p", "table") and links[i] > 2 and link[i] > 0.8 * chars[i]
                doubt[i] = self.doubtful[i] or of_links or p >= 0 and doubt[p]
        # what is in doubt stays between pieces of text that are not
        sure = [k for k, (i, s) in enumerate(self.pieces) if s and not s.isspace() and keep[i] and not doubt[i]]
        self.first, self.last, self.doubt = (sure[0], sure[-1], doubt) if sure else (0, len(self.pieces), doubt)
        return keep

    def _beside(self, i: int, best: int) -> bool:
        """A heading just outside the main node, in the same parent."""
        return self.parent[i] == self.parent[best] and i < best

    def article(self) -> str:
        keep = self.select()
        parts: list[str] = []
        for k, (i, s) in enumerate(self.pieces):
            if s is None:
                parts.append(" ")
            elif keep[i] and (not self.doubt[i] or self.first < k < self.last):
                parts.append(s)
        return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    return Page(html).article() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    p = pages.select("page_id", "url", "html")

    def rows(it):
        for batch in it:
            text = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    return p.mapInArrow(rows, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


NAME, ORACLE = "op3_html_text", None
