"""Operator 5: main text of web pages by composite text density.

Every element has C characters, T tags, LC characters and LT tags in links.  Its density
is C / T, lowered for links: C / T * log(C / LC * T / LT) to the base
ln(C / (C - LC) * LC + LCb / Cb * C + e), with 1 for a zero count and b for the body.
An element's density sum is that of its children.  The element with the greatest sum is
the main part.  The least density on its path from the body is the threshold: where the
main part is in no article, elements outside it belong to the text too if their density
reaches the threshold and their sum a set share (``SHARE``) of the greatest one.

Of an article that holds the main part all is taken, of a ``main`` element all but blocks
of links; else the last first-level heading before the main part belongs to it.  What
the page itself marks as something else never counts: elements for menus, forms, scripts,
footers, asides and the like, headers (but for those with a heading, inside another element
than the body and without a menu or form), classes, ids and roles that say so (``STRONG`` words at the
start or end of a name, ``WHOLE`` names, ``OUTSIDE`` names unless inside an article), and,
outside articles, what follows a heading like "Comments" in its element.

A page is parsed and measured alone, in time linear in its length (each name keeps the
places of its open elements), so pages need no shuffle.  Defined cases: null html is
the empty page; empty pages and those with boilerplate only give the empty text; markup cut
off at the end is dropped; after a quote in a tag that never ends, quotes are ignored;
repeated rows are extracted each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SHARE, LINKS = 0.2, 0.66
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(?P<broken><(?=/?[a-zA-Z]))""", re.S)
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(?P<broken><(?=/?[a-zA-Z]))", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BOILERPLATE = RAW | frozenset("nav footer aside form button select option menu dialog head svg math canvas object audio video map datalist".split())
BLOCK = frozenset("address article aside blockquote body br_ caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td_ tfoot thead tr ul".split())
#: What an opening tag closes before it, up to the named elements.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
CLOSES_P = BLOCK - {"body", "html", "br_", "td_", "caption", "tbody", "thead", "tfoot", "tr"}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRONG = frozenset("ad ads adv advert advertisement advertising adsense adslot sponsor sponsored sponsors promo promos sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent newsletter subscribe subscription signup login popup modal comment comments commentlist disqus pagination pager banner contentinfo complementary".split())
WHOLE = frozenset("header site-header page-header top-header main-header notice site-notice page-notice notices share sharing share-buttons share-bar share-links share-tools social social-share social-links social-media related related-posts related-articles related-links related-content recommended recommended-posts recommendations replies respond skip-link skip-links search-form search-box search-bar site-search dialog alertdialog".split())
OUTSIDE = frozenset("alert notification search side toolbar widget widgets".split())
COMMENTS = re.compile(r"(?:\d+\s+|reader\s+|leave\s+a\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\W*\d*\W*", re.I)


@functools.lru_cache(maxsize=50_000)
def said(attributes: str) -> int:
    """What a tag's attributes say of it: 0 nothing, 1 boilerplate, 2 boilerplate unless in an article."""
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 1
        if key in ("class", "id", "role"):
            for name in value.split():
                words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
                whole = "-".join(words)
                if words and (words[0] in STRONG or words[-1] in STRONG or whole in WHOLE):
                    return 1
                if whole in OUTSIDE:
                    found = 2
    return found


class Page:
    """Elements in page order: parent, name and what marks them; texts with their element."""

    def __init__(self, source: str) -> None:
        self.parent, self.name, self.said = [-1], ["#root"], [0]
        self.parts: list[tuple[int, str]] = []  # (element, text); an empty text ends a block
        self.open, self.places, self.solid = [0], {}, [0]  # open elements; by name, and of those that aren't inline, their places there
        at, n, token = 0, len(source), TOKEN
        add, lower, seen = self.parts.append, None, set()
        while at < n:
            m = token.search(source, at)
            if not m:
                add((self.open[-1], source[at:]))
                break
            if m.start() > at:
                add((self.open[-1], source[at : m.start()]))
            if m["broken"]:
                at = m.start()
                if token is PLAIN:  # no tag ends after this
                    break
                token = PLAIN
                continue
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
                continue
            if name in CLOSES_P:
                self.close(("p",), ("button", "table", "td", "th"))
            if name in CLOSES:
                self.close(*CLOSES[name])
            if name in BLOCK:
                add((self.open[-1], ""))
            if name in ("br", "td", "th"):
                add((self.open[-1], " "))
            if name in VOID:
                continue
            if name in ("body", "html"):
                if name in seen:
                    continue
                seen.add(name)
            self.parent.append(self.open[-1])
            self.name.append(name)
            self.said.append(1 if name in BOILERPLATE else said(m[3]) if m[3] and name not in ("body", "html", "article", "main") else 1 if name == "article" and said(m[3]) == 1 else 0)
            if m[3].endswith("/") and name in ("svg", "path"):
                continue
            self.places.setdefault(name, []).append(len(self.open))
            if name not in INLINE:
                self.solid.append(len(self.open))
            self.open.append(len(self.name) - 1)
            if name in RAW:
                lower = source.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == n else source.find(f"</{name}", at)
                at = n if end < 0 else end

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self.places[k][-1] for k in names if self.places.get(k)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            name = self.name[self.open.pop()]
            self.places[name].pop()
            if name not in INLINE:
                self.solid.pop()

    def end(self, name: str) -> None:
        place = self.last((name,))
        if place < 0 or name in INLINE and place < self.solid[-1]:
            return
        if name in BLOCK:
            self.parts.append((self.open[place], ""))
        self.cut(place)

    def close(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        place = self.last(names)
        if place > self.last(stops):
            self.parts.append((self.open[place], ""))
            self.cut(place)

    def marked(self) -> list[bool]:
        """For each element, whether it or one around it is boilerplate."""
        parent, name, n = self.parent, self.name, len(self.parent)
        heading, menu, article = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            article[k] = article[parent[k]] or name[k] == "article"
        for k in range(n - 1, 0, -1):
            heading[parent[k]] |= heading[k] or name[k] in HEADINGS
            menu[parent[k]] |= menu[k] or name[k] in ("nav", "form")
        bad = [False] * n
        for k in range(1, n):
            own = self.said[k] == 1 or self.said[k] == 2 and not article[k]
            if name[k] == "header":
                own |= not heading[k] or menu[k] or name[parent[k]] in ("body", "html", "#root")
            bad[k] = bad[parent[k]] or own
        # outside articles, a heading like "Comments" ends what belongs to the page's author in its element
        words: dict[int, list[str]] = {}
        for k, text in self.parts:
            while k > 0 and name[k] in INLINE:
                k = parent[k]
            if text and name[k] in HEADINGS and not article[k] and not bad[k]:
                words.setdefault(k, []).append(text)
        ended: dict[int, int] = {}
        for k, texts in words.items():
            if COMMENTS.fullmatch(" ".join(html.unescape("".join(texts)).split())):
                ended.setdefault(parent[k], k)
        if ended:
            for k in range(1, n):
                bad[k] |= bad[parent[k]] or k >= ended.get(parent[k], n)
        self.inside = article
        return bad

    def chosen(self) -> list[bool]:
        """For each element, whether its text belongs to the main text."""
        parent, name, bad = self.parent, self.name, self.marked()
        n = len(parent)
        c, t, lc, lt = [0] * n, [1] * n, [0] * n, [0] * n
        link, around = [False] * n, [0] * n  # around: the innermost article or main element, or 0
        for k in range(1, n):
            link[k] = link[parent[k]] or name[k] == "a"
            around[k] = k if name[k] in ("article", "main") else around[parent[k]]
            if name[k] == "main" and around[parent[k]] and name[around[parent[k]]] == "article":
                around[k] = around[parent[k]]
            lt[k] = link[k] and 1
            if bad[k]:
                t[k] = lt[k] = 0
        for k, text in self.parts:
            if text and not bad[k]:
                size = len(" ".join(text.split()))
                c[k] += size
                if link[k]:
                    lc[k] += size
        for k in range(n - 1, 0, -1):
            p = parent[k]
            c[p], t[p], lc[p], lt[p] = c[p] + c[k], t[p] + t[k], lc[p] + lc[k], lt[p] + lt[k]
        body = name.index("body") if "body" in name else 0
        share = lc[body] / max(1, c[body])
        density = [0.0] * n
        for k in range(n):
            if c[k] and not bad[k]:
                base = math.log(c[k] / max(1, c[k] - lc[k]) * lc[k] + share * c[k] + math.e)
                ratio = c[k] / max(1, lc[k]) * (max(1, t[k]) / max(1, lt[k]))
                density[k] = c[k] / max(1, t[k]) * math.log(max(ratio, 1.0)) / max(math.log(base), 1.0) if base > 1 else 0.0
        sums = [0.0] * n
        for k in range(1, n):
            sums[parent[k]] += density[k]
        top = max(range(n), key=lambda k: (sums[k], density[k], -k))
        if not sums[top]:
            top = max(range(n), key=lambda k: (density[k], -k))
        threshold, k = density[top], top
        while k > 0 and k != body:
            k = parent[k]
            threshold = min(threshold, density[k])
        mark = [False] * n
        in_article = name[around[top]] == "article"
        for k in range(n):
            if k == top or not bad[k] and density[k] >= threshold and sums[k] >= SHARE * sums[top] > 0 and k not in (0, body) and name[k] != "html" and (not in_article or self.inside[k]):
                mark[around[k] or k] = True
        for k in range(n):
            if mark[k] and name[k] == "main":
                for j in range(k + 1, n):  # blocks of links
                    if parent[j] == k and c[j] and lc[j] > LINKS * c[j]:
                        bad[j] = True
        for k in range(1, n):
            bad[k] |= bad[parent[k]]
            mark[k] = (mark[k] or mark[parent[k]]) and not bad[k]
        if not around[top] and not any(mark[k] and name[k] == "h1" for k in range(n)):
            title = max((k for k in range(1, top) if name[k] == "h1" and not bad[k]), default=0)
            for k in range(title, n if title else 0):
                mark[k] |= k == title or k > title and mark[parent[k]] and not bad[k]
        return mark

    def text(self) -> str:
        mark = self.chosen()
        blocks, now = [], []
        for k, part in self.parts:
            if part:
                if mark[k]:
                    now.append(html.unescape(part))
            elif now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
