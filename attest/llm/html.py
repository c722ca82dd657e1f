"""Main text of web pages: element rules, and removal of site templates by counted subtree hashes.

Every page is parsed once for hashes and once for text.  A subtree's hash covers its tags and its text.  Hashes are
counted per host over all pages, each different page content of a host counting once, so that copies of an article
don't make it a template.  A subtree goes if it is on ``LEAST`` of a host's contents and on ``RARE`` of them, so that
templates of one section of a large host go too; on a smaller host half of its contents suffice, but ``FEWEST`` at
least.  A paragraph, heading, list item or table cell inside an article or main element may be prose that recurs, and
goes only if it is on ``SHARE`` of the contents too.  Templates meet the pages that hold them by host and hash, so their
number is not bounded; a hash that is on very many pages is split by AQE, as the join is a plain one.

Whatever its host, a page loses navigation, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments by their tags, roles, classes and ids.  A class or id counts by what its last telling word names:
``site-footer`` and ``comment-list`` are junk, ``share-price``, ``no-sidebar`` and ``has-comments`` are not.  An outermost
article or main element is never junk by its class, and where all articles of a page stand in elements that are junk by
class, those classes don't count for them.  Where a page has an article or main element, other text is kept only if it
stands in a paragraph, quotation, preformatted text or first heading; what recurs of that is left to the templates.

Pages are read in linear time: no tag, quote or end tag makes the reader go back over the source or the open elements.

Cases: a null or empty html gives an empty text; a null url has the empty host, whose pages are counted together;
unclosed, misplaced and unknown tags are tolerated; repeated rows give repeated result rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Of a host's different contents: for prose in articles, and for all else.
SHARE, RARE = 0.5, 0.01
#: Contents of a host: for hosts of any size, and for small ones.  Measured on made pages of hosts of 8 to 300, with unmarked
#: templates on 10% to all of a host's pages: 97% of template blocks go, and of 9,380 blocks of text none (with 20 in place of 10: 95%).
LEAST, FEWEST = 10, 6

_MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: In a tag: what ends it, or a quoted value, which may hold such a sign.
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_JUNK = set("head nav footer aside form script style noscript template iframe svg button select input textarea object canvas menu dialog title audio video map datalist".split())
_JUNK_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_JUNK_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond share sharing social login signin signup search toolbar pagination pager form related recommended skip".split()
)
#: Of an article's own text, when they stand in one.
_PROSE = set("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre td th tr caption figcaption summary".split())
#: Of a page, but not of an article.
_JUNK_OUTSIDE = {"header", "banner", "alert", "topbar", "widget"}
#: Parts of names that say where or what shape an element is, not what it holds.
_SHAPES = set("area banner bar block body bottom box button column container content desktop fixed group holder icon inner item items left link links list lower main mobile outer panel right row section small sticky strip text title top upper view wrap wrapper zone".split())
#: Names that begin so tell of something else.
_DENIALS = set("has have hide is no non not off sans show with without".split())
#: An element of such a class is not junk for another class that only holds a junk word.
_CONTENT = set("article content entry main page post story text".split())
#: What is kept outside the articles of a page that has any.
_LOOSE = {"p", "pre", "blockquote", "h1"}
#: An opening tag ends an open element of its own kind, as HTML allows them to stay unclosed.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: ... but not across these.
_SCOPE = set("table ul ol dl article section main div body nav aside footer header form blockquote select".split())


def _junk_name(name: str, article: bool) -> bool:
    """Whether a class or id names junk."""
    parts = [x.lower() for x in _PART.findall(name)]
    if not parts or parts[0] in _DENIALS:
        return False
    telling = [x for x in parts if x not in _SHAPES] or parts
    return telling[-1] in _JUNK_WORDS or not article and telling[-1] in _JUNK_OUTSIDE


#: Kept, junk by name, junk by tag, role or style.
_KEPT, _NAMED, _SURE = range(3)


def _junk(tag: str, attributes: str, article: bool) -> int:
    """How sure an element is junk; ``article`` tells whether it stands in an article."""
    if tag in _JUNK or tag == "header" and not article:
        return _SURE
    if not attributes or tag in ("body", "html"):
        return _KEPT
    exact = named = content = False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for x in value.split():
                exact |= x.lower() in _JUNK_WORDS
                content |= x.lower() in _CONTENT
                named |= _junk_name(x, article)
        elif name == "role" and value.lower() in _JUNK_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _SURE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _SURE
    return _NAMED if (exact or named and not content) and (article or tag not in ("article", "main")) else _KEPT


class _Node:
    __slots__ = ("tag", "junk", "article", "loose", "parts", "first", "text")

    def __init__(self, tag: str, junk: int, article: bool, loose: bool, first: int):
        self.tag, self.junk, self.article, self.loose, self.first = tag, junk, article, loose, first
        self.parts: list[str] = []
        self.text = False


class Page:
    """The blocks of one page, and the hashed subtrees with the blocks that each holds."""

    def __init__(self, source: str | None):
        self.texts: list[str] = []
        #: (junk, in an article, may stand outside one) of each block
        self._states: list[tuple[int, bool, bool]] = []
        #: (hash, first block, block after the last); a hash is odd for prose in an article
        self.trees: list[tuple[int, int, int]] = []
        self._pending: list[str] = []
        self._state = (_KEPT, False, False)
        self._stack = [_Node("", _KEPT, False, False, 0)]
        #: Where in the stack elements of a tag are, and those of _SCOPE and of _BLOCK.
        self._at: dict[str, list[int]] = {}
        self._scopes, self._blocks = [0], [0]
        if source:
            self._parse(source)
        #: Whether the element rules keep a block.
        self.kept = self._ruled()

    def _ruled(self) -> list[bool]:
        states = self._states
        level = _KEPT
        if not any(a for junk, a, _ in states if junk == _KEPT) and any(a for junk, a, _ in states if junk == _NAMED):
            level = _NAMED
        whole = not any(a for junk, a, _ in states if junk <= level)
        return [junk == _KEPT and (whole or a or loose) or junk <= level and a for junk, a, loose in states]

    def _flush(self) -> None:
        if self._pending:
            text = " ".join("".join(self._pending).split())
            self._pending.clear()
            if text:
                self.texts.append(text)
                self._states.append(self._state)

    def _say(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        top = self._stack[-1]
        state = (top.junk, top.article, top.loose)
        if state != self._state:
            self._flush()
            self._state = state
        self._pending.append(text)
        if not text.isspace():
            top.parts.append(" ".join(text.split()))
            top.text = True

    def _close(self, depth: int) -> None:
        """Close all elements down to that depth of the stack."""
        while len(self._stack) > depth:
            node = self._stack.pop()
            self._at[node.tag].pop()
            for held, tags in ((self._scopes, _SCOPE), (self._blocks, _BLOCK)):
                if node.tag in tags:
                    held.pop()
            if node.tag in _BLOCK or node.tag in _JUNK:
                self._flush()
            if node.text:
                up = self._stack[-1]
                h = xxhash.xxh64_intdigest(f"{node.tag}\x01" + "\x02".join(node.parts))
                up.parts.append(f"{h:x}")
                up.text = True
                if node.tag in _BLOCK and node.tag not in ("html", "body", "main", "article") and len(self.texts) > node.first:
                    h = h & ~1 | (node.article and node.tag in _PROSE)
                    self.trees.append((h - (1 << 64) if h >> 63 else h, node.first, len(self.texts)))

    def _end_tag(self, tag: str) -> None:
        if found := self._at.get(tag):
            depth = found[-1]
            # An inline element that ends inside a later block doesn't end that.
            if tag in _BLOCK or tag in _JUNK or self._blocks[-1] < depth or self._stack[depth].junk != self._stack[depth - 1].junk:
                if tag in _BLOCK:
                    self._flush()
                self._close(depth)
        elif tag == "p":
            self._flush()
        elif tag == "br":
            self._say(" ")

    def _start_tag(self, tag: str, attributes: str) -> bool:
        """Open an element; whether it is open now."""
        if tag in _VOID:
            if tag == "br":
                self._say(" ")
            elif tag == "hr":
                self._flush()
            return False
        if tag in _BLOCK:
            self._flush()
        if ends := _ENDS.get(tag) or ({"p"} if tag in _BLOCK else None):
            open_ones = [self._at[x][-1] for x in ends if self._at.get(x) and self._at[x][-1] > self._scopes[-1]]
            if open_ones:
                self._close(min(open_ones))
        top = self._stack[-1]
        article = top.article or tag in ("article", "main")
        loose = tag in _LOOSE or top.loose and tag not in _BLOCK
        depth = len(self._stack)
        self._at.setdefault(tag, []).append(depth)
        if tag in _SCOPE:
            self._scopes.append(depth)
        if tag in _BLOCK:
            self._blocks.append(depth)
        self._stack.append(_Node(tag, max(top.junk, _junk(tag, attributes, top.article)), article, loose, len(self.texts)))
        if attributes.endswith("/") and tag in ("svg", "iframe", "script"):
            self._close(depth)
            return False
        return True

    def _parse(self, source: str) -> None:
        said = at = 0  # what comes before said has been read; what is searched begins at at
        while (at := source.find("<", at)) >= 0:
            m = _MARKUP.match(source, at)
            if not m:
                at += 1
                continue
            end = source.find("-->", m.end()) + 3 if m[1] else source.find(">", m.end()) + 1 if m[2] else self._tag_end(source, m.end())
            if end < 3:
                if m[4]:  # no tag ends from here on
                    break
                end = len(source)
            self._say(source[said:at])
            said = at = end
            if not m[4]:
                continue
            tag = m[4].lower()
            if m[3]:
                self._end_tag(tag)
            elif self._start_tag(tag, source[m.end() : end - 1]) and tag in _RAW:
                close = _RAW[tag].search(source, at)
                said = at = close.end() if close else len(source)
                self._close(len(self._stack) - 1)
        self._say(source[said:])
        self._close(1)
        self._flush()

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """Behind the sign that ends a tag; 0 if none does.  A quote that is never closed hides nothing."""
        while m := _STOP.search(source, at):
            if not m[1]:
                return m.end()
            close = source.find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return 0

    def shown(self) -> list[int]:
        """The hashes of subtrees that hold some text which the element rules keep."""
        before = [0, *itertools.accumulate(self.kept)]
        return sorted({h for h, first, last in self.trees if before[last] > before[first]})

    def text(self, templates: set[int] | None = None) -> str:
        steps = [0] * (len(self.texts) + 1)
        for h, first, last in self.trees if templates else ():
            if h in templates:
                steps[first] += 1
                steps[last] -= 1
        return "\n".join(t for t, ok, gone in zip(self.texts, self.kept, itertools.accumulate(steps)) if ok and not gone)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without any."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, key, source in zip(pdf["host"], pdf["key"], pdf["html"]):
            page = Page(source)
            content = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass"))
            rows.append((host, key, content - (1 << 64) if content >> 63 else content, sorted({h for h, _, _ in page.trees}), page.shown()))
        yield pd.DataFrame(rows, columns=["host", "key", "content", "hashes", "shown"])


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, rare: float = RARE, fewest: int = FEWEST) -> DataFrame:
    """host, key and an array of the hashes of its templates, for each different page that holds any."""
    each = written(pages.select("host", "key", "html").mapInPandas(_hashes, "host string, key binary, content long, hashes array<long>, shown array<long>"))
    # One row for each different content of a host; any of its rows' hashes will do, so take the least.
    contents = each.groupBy("host", "content").agg(F.min("hashes").alias("hashes"))
    counts = contents.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(least, fewest))
    totals = each.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    n, total, prose = F.col("n"), F.col("total"), F.col("hash").bitwiseAND(F.lit(1)) == 1
    floor = F.greatest(F.least(F.lit(float(least)), F.greatest(F.lit(float(fewest)), total / 2)), rare * total)
    often = written(counts.join(totals, "host").filter((n >= floor) & (~prose | (n >= share * total))).select("host", "hash"))
    held = each.dropDuplicates(["host", "key"]).select("host", "key", F.explode("shown").alias("hash")).join(often, ["host", "hash"])
    return held.groupBy("host", "key").agg(F.collect_list("hash").alias("hashes"))


def extracted(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    key = F.unhex(F.md5("html")).alias("key")
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), key)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [Page(s).text(set(h.tolist()) if h is not None else None) for s, h in zip(pdf["html"], pdf["hashes"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(t) for t in out]})

    # What pages hold is written first, so that both sides of the join are shuffled for it and a page of many copies can be split.
    found = pages.join(written(templates(pages, share, least)), ["host", "key"], "left").select("page_id", "url", "html", "hashes")
    done = found.mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return done.withColumn("page_id", F.col("page_id").cast("long"))


query = extracted
