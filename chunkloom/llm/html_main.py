"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks. From the best one a page climbs to the article or main
around it, or else as high as what is added isn't mostly links, so that headline, lead and sibling sections come along; the
path of that container (tags with their classes, digits made alike) is the page's vote. Votes are summed in Spark by host
and path, and the winning path of a host re-extracts all its pages; a page that hasn't the winning path, or would lose text
of its own container or gain mostly links by it, keeps its own container.

What isn't main text is told by elements and roles, and by classes and ids whose words name page furniture. The words
decide only when the whole page is read: an element around an article or main, or around most of the page's text, stays;
ids of headings and paragraphs say nothing; a page that they leave empty is read without them.

Defined results: null and empty html, and pages without text, give an empty text; pages without a host (null or odd urls)
use their own best container; markup that is never closed ends with its parent or the page; a reference that names nothing
stays as it stands; white space is Unicode's; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, free_names, in_small_batches, table, tidy

#: HTML's raw text, void and inline elements, and elements that end an open one of their kind.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may stand within a paragraph without ending it, though what they hold isn't its text; formulas, whose text is.
_ASIDES = frozenset("svg script style noscript template button select textarea iframe object canvas audio video input annotation annotation-xml".split())
_MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msub msup msubsup munder mover munderover mfrac msqrt mroot mstyle mpadded mphantom menclose merror mtable mtr mtd mmultiscripts mprescripts none".split())
_FLOWS = _INLINE | _ASIDES | _MATH
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
_SCOPES = frozenset("ul ol dl table select html body article main section div aside nav header footer form".split())
#: Elements, and words in classes and ids, that mark what isn't main text.
_OUT = frozenset("head nav aside footer form menu script style noscript template svg annotation annotation-xml iframe object select button textarea title dialog canvas audio video".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended comment comments commentlist respond disqus reply replies skip".split()
)
#: Words that may stand beside those in one name without changing what it names, words that make it a state of a layout,
#: and names of the layout itself.
_BESIDE = frozenset("area bar block blocks box button buttons card cards col column container content entries footer form global group icons inner item items left link links list main modal outer page panel posts primary right secondary section site slot social stories title top unit wrap wrapper".split())
_STATES = frozenset("has with no without".split())
_LAYOUT = frozenset("page site layout wrap wrapper container content main body".split())
_COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
_NO_IDS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WEAK, _STRONG = 1, 2
_OUT_NAMES = frozenset(("header", "site-header", "page-header", "site_header", "page_header"))
_GOOD_WORDS = frozenset("article content post entry main story body text prose".split())
_WHOLE = frozenset(("html", "body", "article", "main", ""))
#: A comment, a declaration or a tag, which ends at the first > that isn't in a quoted value. Where there is none, the last
#: alternative says so, and the rest of the page is read with tags that end at any > (or the page's end): no place is scanned
#: twice, however broken the page.
_NOT_TAG = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_TOKEN = re.compile(_NOT_TAG + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|(</?[a-zA-Z])""", re.S)
_PLAIN_TOKEN = re.compile(_NOT_TAG + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?<![\w:-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names_furniture(name: str, is_id: bool, inside: bool) -> int:
    """How surely a class or id names what isn't main text: not, _WEAK (some word of it does) or _STRONG (as a whole, or
    its last word). inside: in an article or main, where a weak name says nothing, and an id may be made of a heading."""
    words = _WORDS.findall(name)
    if _OUT_WORDS.isdisjoint(words) or words[0] in _STATES:
        return 0
    if all(w in _OUT_WORDS or w in _BESIDE for w in words) and (words[0] in _OUT_WORDS or words[-1] in _OUT_WORDS) and not (len(words) > 2 and words[0] in _LAYOUT):
        return _STRONG
    if inside and is_id:
        return 0
    if words[-1] in _OUT_WORDS or words[0] in _COMMENTS:
        return _STRONG
    return 0 if inside else _WEAK


class Page:
    """Elements in page order (parent, generalised name, whether it is outside the main text) and blocks of text."""

    def __init__(self, html: str):
        self.parent, self.name, self.tag, self.out, self.good, self.main = [-1], [""], [""], [False], [False], [False]
        self.named, self.inside_article, self.block = [0], [False], [0]  # block: the element that text in this one belongs to
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters in links
        self._pieces: list[tuple[int, list[tuple[int, str, bool]]]] = []  # owner, (element, text, whether in a link)
        self._read(html)
        by_name = self._outside_by_name()
        self._build(by_name)
        if by_name and not self.blocks:
            self._build([])
        self._pieces.clear()

    def _outside_by_name(self) -> list[bool]:
        """Of each element, whether a name on it or above it puts it outside the main text; empty where none does."""
        if not any(self.named):
            return []
        count = len(self.tag)
        holds_main, holds_article, free = [m and not o for m, o in zip(self.main, self.out, strict=True)], [t == "article" and not o for t, o in zip(self.tag, self.out, strict=True)], [0] * count
        for n in range(count - 1, 0, -1):
            holds_main[self.parent[n]] |= holds_main[n]
            holds_article[self.parent[n]] |= holds_article[n]
        aside = [False] * count
        for n in range(1, count):
            aside[n] = aside[self.parent[n]] or self.named[n] == _STRONG and not holds_main[n] and not holds_article[n]
        for _, pieces in self._pieces:
            for n, piece, linked in pieces:
                if not linked and not aside[n]:
                    free[n] += len(piece.strip())
        for n in range(count - 1, 0, -1):
            free[self.parent[n]] += free[n]
        out = [False] * count
        for n in range(1, count):
            most = 2 * free[n] > free[0]
            stays = holds_main[n] or (holds_article[n] and most if self.named[n] == _STRONG else holds_article[n] or most)
            out[n] = out[self.parent[n]] or bool(self.named[n]) and not stays
        return out

    def _build(self, outside: list[bool]) -> None:
        for owner, pieces in self._pieces:
            if outside:
                pieces = [p for p in pieces if not outside[p[0]]]
            block = " ".join("".join([p[1] for p in pieces]).split())
            if block:
                self.blocks.append((owner, block, min(sum(len(p[1]) for p in pieces if p[2]), len(block))))

    def _read(self, html: str) -> None:
        stack, text, links, at = [0], [], 0, 0
        counts: dict[str, int] = {}  # open elements by tag: an end tag without a start costs nothing
        lowered, token = None, _TOKEN

        def flush() -> None:
            if text:
                self._pieces.append((self.block[stack[-1]], text.copy()))
                text.clear()

        def close(tag: str) -> None:
            nonlocal links
            while True:
                n = stack.pop()
                t = self.tag[n]
                counts[t] -= 1
                if t == "a":
                    links -= 1
                if t == tag:
                    return

        def put(piece: str) -> None:
            if piece and not self.out[stack[-1]]:
                piece = unescape(piece) if "&" in piece else piece
                text.append((stack[-1], piece, links > 0))

        while m := token.search(html, at):
            put(html[at : m.start()])
            if token is _TOKEN and m[4]:
                token, at = _PLAIN_TOKEN, m.start()
                continue
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            seen = not self.out[stack[-1]]  # what stands in an element outside the text ends no block around it
            if tag not in _FLOWS:
                if seen:
                    flush()
            elif tag in ("br", "img") and seen:
                text.append((stack[-1], " ", False))
            if m[1]:
                if counts.get(tag):
                    close(tag)
                continue
            if tag not in _FLOWS and seen and counts.get("p"):
                self._end_open(stack, counts, ("p",), close)
            if tag in _ENDS and any(counts.get(t) for t in _ENDS[tag]):
                self._end_open(stack, counts, _ENDS[tag], close)
            if tag in _VOID or m[3].endswith("/") and tag not in _OUT:
                continue
            if tag in _RAW:
                lowered = lowered or html.lower()
                end = lowered.find(f"</{tag}", at) if len(lowered) == len(html) else (x.start() if (x := re.compile(f"</{tag}", re.I).search(html, at)) else -1)  # some lower cases are longer
                end = end if end >= 0 else len(html)
                at = len(html) if (close_at := html.find(">", end)) < 0 else close_at + 1
                continue
            self._open(tag, m[3], stack[-1])
            stack.append(len(self.tag) - 1)
            counts[tag] = counts.get(tag, 0) + 1
            if tag == "a":
                links += 1
        put(html[at:])
        flush()

    def _end_open(self, stack: list[int], counts: dict[str, int], tags: tuple[str, ...], close) -> None:
        for n in reversed(stack):
            t = self.tag[n]
            if t in tags:
                close(t)
                return
            if t in _SCOPES:
                return

    def _open(self, tag: str, attributes: str, parent: int) -> None:
        classes, ids, words, role, named = [], [], set(), "", set()
        if attributes:
            for a in _ATTR.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                if (key := a[1].lower()) == "role":
                    role = value
                else:
                    named.update(value.split())
                    words.update(_WORDS.findall(value))
                    (classes if key == "class" else ids).extend(value.split())
        out = tag in _OUT or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        inside, main = self.inside_article[parent], tag == "main" or role == "main"
        out = out or tag == "header" and not inside
        how = 0
        if tag not in _WHOLE and not main:
            if named & _OUT_NAMES and not inside:
                how = _STRONG
            if words & _OUT_WORDS:
                how = max([how, *(_names_furniture(c, False, inside) for c in classes), *(_names_furniture(i, True, inside) for i in ids if tag not in _NO_IDS)])
            if how and not _LAYOUT.isdisjoint(classes):
                how = _WEAK
        self.block.append(self.block[parent] if tag in _FLOWS else len(self.tag))
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(".".join((tag, *sorted({re.sub(r"\d+", "#", c) for c in classes}))))
        self.out.append(out or self.out[parent])
        self.named.append(how)
        self.inside_article.append(inside or tag in ("article", "main"))
        self.main.append(main)
        self.good.append(tag in ("article", "main") or role == "main" or bool(words & _GOOD_WORDS))

    def best(self) -> tuple[int, list[float]]:
        """(the container with the most text, scores of all elements). A block's text counts for the element that holds
        its paragraph, and half for the one above."""
        score = [0.0] * len(self.tag)
        for owner, text, linked in self.blocks:
            n = owner
            if self.tag[n] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "blockquote", "td", "tr", "tbody", "table", "dd", "dt", "dl", "figcaption"):
                while self.tag[n] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "blockquote", "td", "th", "tr", "tbody", "thead", "table", "dd", "dt", "dl", "figcaption", "figure") or self.tag[n] in _FLOWS:
                    n = self.parent[n]
            gain = len(text) - linked
            score[n] += gain
            if n:
                score[self.parent[n]] += gain / 2
        weighed = [s * 1.5 if g else s for s, g in zip(score, self.good, strict=True)]
        return max(range(len(weighed)), key=lambda i: (weighed[i], -i)), score

    def totals(self) -> tuple[list[int], list[int]]:
        """Characters of text, and of those the linked ones, in each element with all that it holds. A headline that links
        to its own page counts as text."""
        chars, linked = [0] * len(self.tag), [0] * len(self.tag)
        for owner, text, links in self.blocks:
            chars[owner] += len(text)
            linked[owner] += 0 if self.tag[owner] in _HEADINGS else links
        for n in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[n]] += chars[n]
            linked[self.parent[n]] += linked[n]
        return chars, linked

    def climbed(self, n: int) -> int:
        """The container around n with what belongs to it: the outermost article, then a main that holds no other article;
        without either, the highest ancestor whose additional text isn't mostly links."""
        chars, linked = self.totals()
        above = [n]
        while above[-1] > 0:
            above.append(self.parent[above[-1]])
        articles = [m for m in above if self.tag[m] == "article"]
        mains = [m for m in above if self.main[m]]
        if articles or mains:
            top = articles[-1] if articles else mains[-1]
            if articles and mains and mains[-1] < top and not any(self.tag[m] == "article" and chars[m] and not self._within(m, top) and self._within(m, mains[-1]) for m in range(1, len(self.tag))):
                further = mains[-1]
                top = further if _few_links(chars[further] - chars[top], linked[further] - linked[top]) else top
            return top
        top = n
        for m in above[1:]:
            if chars[m] > chars[top] and _few_links(chars[m] - chars[n], linked[m] - linked[n]):
                top = m
        return top

    def _within(self, n: int, top: int) -> bool:
        while n > top:
            n = self.parent[n]
        return n == top

    def path(self, n: int) -> str:
        names = []
        while n > 0:
            names.append(self.name[n])
            n = self.parent[n]
        return ">".join(reversed(names))

    def at_path(self, path: str) -> list[int]:
        """Elements with this generalised path."""
        names = path.split(">") if path else []
        depth = [0] + [-1] * (len(self.tag) - 1)
        if not names:
            return [0]
        found = []
        for n in range(1, len(self.tag)):
            d = depth[self.parent[n]]
            if 0 <= d < len(names) and self.name[n] == names[d]:
                depth[n] = d + 1
                if d + 1 == len(names):
                    found.append(n)
        return found

    def inside(self, chosen: list[int]) -> list[bool]:
        """Of each element, whether it is one of the chosen or in one."""
        inside = [False] * len(self.tag)
        for n in chosen:
            inside[n] = True
        for n in range(1, len(inside)):
            inside[n] = inside[n] or inside[self.parent[n]]
        return inside

    def text(self, chosen: list[int]) -> str:
        inside = self.inside(chosen)
        return "\n".join([t for owner, t, _ in self.blocks if inside[owner]])

    def keeps(self, chosen: list[int], own: int) -> bool:
        """Whether the chosen elements hold all text of own, and what they add isn't mostly links."""
        here, there = self.inside([own]), self.inside(chosen)
        chars = linked = 0
        for owner, text, links in self.blocks:
            if here[owner] and not there[owner]:
                return False
            if there[owner] and not here[owner]:
                chars += len(text)
                linked += 0 if self.tag[owner] in _HEADINGS else links
        return _few_links(chars, linked)


def _few_links(chars: int, linked: int) -> bool:
    return 2 * linked <= chars


def extract(html: str | None, path: str | None) -> tuple[str, str]:
    """(main text, path used)"""
    page = Page(html if isinstance(html, str) else "")
    own = page.climbed(page.best()[0])
    if isinstance(path, str):
        chosen = page.at_path(path)
        if chosen and page.keeps(chosen, own):
            return page.text(chosen), path
    return page.text([own]), page.path(own)


def host_of(url: Column) -> Column:
    """Host of a url, lower-cased, without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the path that most pages of a host vote for (then most text, then the first in code point order)."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, html in zip(pdf["host"].tolist(), pdf[html_col].tolist(), strict=True):
                page = Page(html if isinstance(html, str) else "")
                n, score = page.best()
                if score[n] > 0:
                    rows.append((host, page.path(page.climbed(n)), score[n]))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    ballots = in_small_batches(pages).select(host_of(F.col(url_col)).alias("host"), html_col).filter("host is not null").mapInPandas(vote, "host string, path string, score double")
    sums = ballots.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    best = F.max_by(F.struct("path", "votes"), F.struct("votes", F.round("score"), F.col("path")))
    return sums.groupBy("host").agg(best.alias("best")).select("host", "best.path", "best.votes")


#: Hosts whose winners are broadcast (some 20 MB); beyond, pages are joined by a shuffle on the host.
BROADCAST_HOSTS = 200_000


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    keep = tuple(k for k in keep if k not in ("text", "path"))
    source, host, path, of = free_names(keep, "h_html", "h_host", "h_path", "h_of")
    winners = cut(host_paths(pages, url_col, html_col).select(F.col("host").alias(host), F.col("path").alias(path)))
    small = winners.count() <= BROADCAST_HOSTS
    own = pages.select(*keep, F.col(html_col).alias(source), host_of(F.col(url_col)).alias(of))
    joined = own.join(F.broadcast(winners) if small else winners, F.col(of) == F.col(host), "left").select(*keep, source, path)
    schema = ", ".join([*(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep), "text string", "path string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract(h, p) for h, p in zip(pdf[source].tolist(), pdf[path].tolist(), strict=True)]
            yield pdf[list(keep)].assign(text=[t for t, _ in found], path=[p for _, p in found])

    return in_small_batches(joined).mapInPandas(tidy(run), schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
