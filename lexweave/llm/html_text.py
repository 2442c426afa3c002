"""Operator 2, HTML extraction by removal of site templates.

Pages are parsed by a small tolerant tree walker in one pass: each element's hash is folded from its texts and its
children's hashes, menus, adverts and footers like all others, so that all subtrees are hashed in time linear in the page.
Spark counts the hashes per host, over distinct pages; subtrees that recur on many pages of a host are its template and are
deleted wherever they stand, inside the article too. Few pages are enough where tag or name speak of a menu, a footer, an
advert; other subtrees must recur on more. Elements of such tags and names that are new on a page are no template; they go
besides. Of the rest, what an <article> or <main> holds is the article, if there is one.

Not deleted are: an article's own paragraphs, headings and lists, even if they recur (a sentence that many articles share
is text of each); and a subtree with more than half of a page's text, so that copies of a page do not delete each other.
Only content is hashed: a hash of tags without text would take articles of one layout for a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import Scratch, small_batches, table

#: A subtree is template if it is on at least LEAST distinct pages of its host and, unless tag or name mark it, on ROOT times the root
#: of their number: 3 of 3, 7 of 10, 20 of 100, 2,000 of 1,000,000.
LEAST, ROOT = 3, 2.0
#: Template tables up to so many bytes on disk are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that never hold the article.
DROPPED = frozenset(
    "head nav footer aside form button select option input label dialog menu object embed video audio canvas svg map fieldset applet frameset".split()
)
HEADERS = frozenset(["header"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id or role that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored promo promos promotion banner sidebar sidebars"
    " menu menus nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts newsletter subscribe"
    " subscription signup popup modal overlay comment comments commentlist disqus reply replies respond social share sharing related"
    " recommended footer toolbar widget widgets pagination pager copyright disclaimer login search skip contentinfo complementary".split()
)
HEADER_MARKS = frozenset("header masthead topbar".split())
#: Words in a class name that speak of such an element without being one: no-sidebar, page-with-comments.
SPEAKING = frozenset("no not non with without has have is hide page layout".split())
#: Elements of words, and those of an article whose words they are.
PHRASES = frozenset("a abbr b cite code del em i ins kbd mark q s small span strong sub sup time u var".split())
PROSE = ("p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
#: Containers that recurrence may delete inside an article.
BOXES = frozenset("div section table ul ol dl figure details".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("html body article main section div table ul ol dl td th blockquote form aside nav header footer".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_RAW_ENDS = {t: re.compile(rf"</{t}\s*[^>]*>|\Z", re.I) for t in RAW}


#: What becomes of text: it stays; it stays in headings of an article; it goes unless nothing else is left; it goes.
KEEP, HEADER, SPARE, DROP = 0, 1, 2, 3
_MASK, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _fold(a: int, b: int) -> int:
    a = ((a ^ b) * _MIX) & _MASK
    return a ^ (a >> 29)


class Node:
    """An open element: its hash so far, the characters in it, those of them that may stay, what becomes of its text, and where its blocks begin."""

    __slots__ = ("tag", "hash", "chars", "shown", "state", "first")

    def __init__(self, tag: str, state: int, first: int):
        self.tag, self.hash, self.chars, self.shown, self.state, self.first = tag, xxhash.xxh3_64_intdigest(tag), 0, 0, state, first


def _marked(value: str) -> tuple[bool, bool]:
    """(whether a class, id or role names an element that never holds the article, whether it names a header)."""
    mark = header = False
    for name in value.split():
        words = {w.lower() for w in _PARTS.split(name)}
        if not words & SPEAKING:
            mark, header = mark or bool(words & MARKS), header or bool(words & HEADER_MARKS)
    return mark, header


def _kind(tag: str, attrs: str, inside: bool, prose: bool) -> int:
    """What becomes of the element's text. Names mark no <article> or <main>, and no words within an article's paragraph, so that a wrong one cannot take them."""
    if tag in DROPPED:
        return DROP
    state = HEADER if tag in HEADERS else KEEP
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                return DROP
            if name in ("class", "id", "role"):
                if tag in ("article", "main"):
                    if set(value.lower().split()) & {"comment", "comments", "related", "ad", "advert", "sponsored", "promo"}:
                        return DROP
                    continue
                mark, header = _marked(value)
                if inside and prose and tag in PHRASES:
                    continue
                if mark:
                    state = max(state, DROP if inside or tag not in BLOCKS else SPARE)
                elif header:
                    state = max(state, HEADER)
    return state


class Page:
    """A parsed page. ``blocks``: (scope, state, text) in order, scope 2 in <main>, 1 in <article>, else 0;
    ``subtrees``: (hash, whether tag or name mark it, characters, those that may stay, first block, block after the last) of elements that
    recurrence may delete; ``hash``, ``chars`` and ``shown`` of the page."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, int, str]] = []
        self.subtrees: list[tuple[int, bool, int, int, int, int]] = []
        self._stack = [Node("", KEEP, 0)]
        #: Open tags by scope: a closing tag that is not counted in its scope closes nothing, so nothing is searched in vain.
        self._frames: list[dict[str, int]] = [{}]
        self._open: dict[str, int] = {}
        self._scopes: list[int] = []
        #: Texts of the open block, and whether each may stay.
        self._held: list[tuple[str, bool]] = []
        self._read(page)
        self.hash, self.chars, self.shown = self._stack[0].hash, self._stack[0].chars, self._stack[0].shown

    def _flush(self) -> None:
        if self._held:
            whole = " ".join("".join(t for t, _ in self._held).split())
            text = whole if all(stays for _, stays in self._held) else " ".join("".join(t for t, stays in self._held if stays).split())
            self._held.clear()
            if whole:
                node = self._stack[-1]
                self.blocks.append((max(self._scopes, default=0), node.state if text else DROP, text))
                node.hash = _fold(node.hash, xxhash.xxh3_64_intdigest(whole))
                node.chars, node.shown = node.chars + len(whole), node.shown + len(text)

    def _push(self, tag: str, state: int) -> None:
        if tag in SCOPES:
            self._frames.append({})
        self._frames[-1][tag] = self._frames[-1].get(tag, 0) + 1
        self._open[tag] = self._open.get(tag, 0) + 1
        self._stack.append(Node(tag, state, len(self.blocks)))
        if tag in ("article", "main"):
            self._scopes.append((2 if tag == "main" else 1) if state < DROP else 0)

    def _pop(self) -> None:
        node = self._stack[-1]
        if node.tag in BLOCKS:
            self._flush()
        self._stack.pop()
        self._open[node.tag] -= 1
        self._frames[-1][node.tag] -= 1
        if node.tag in SCOPES:
            self._frames.pop()
        if node.tag in ("article", "main"):
            self._scopes.pop()
        if node.chars:
            inside = max(self._scopes, default=0) > 0
            if node.tag in BOXES or (node.tag in BLOCKS and not inside and node.tag not in ("html", "body", "article", "main")):
                # A subtree that recurs as a marked element on some pages and as a plain one on others is counted for each.
                self.subtrees.append((_fold(node.hash, node.state > KEEP), node.state > KEEP, node.chars, node.shown, node.first, len(self.blocks)))
            above = self._stack[-1]
            above.hash, above.chars, above.shown = _fold(above.hash, node.hash), above.chars + node.chars, above.shown + node.shown

    def _read(self, page: str) -> None:
        at, n, stack, held = 0, len(page), self._stack, self._held
        while at < n:
            found = _TAG.search(page, at)
            end = found.start() if found else n
            if end > at:
                state = stack[-1].state
                stays = state in (KEEP, SPARE) or (state == HEADER and bool(self._scopes) and any(self._open.get(t) for t in HEADINGS))
                held.append((html.unescape(page[at:end]), stays))
            if not found:
                break
            slash, tag, attrs = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            at = found.end()
            if not tag:
                if found[0].startswith("<![CDATA[") and stack[-1].state in (KEEP, SPARE):
                    held.append((found[0][9:-3], True))
                continue
            tag = tag.lower()
            if slash:
                if self._open.get(tag) if tag in SCOPES else self._frames[-1].get(tag):
                    while stack[-1].tag != tag:
                        self._pop()
                    self._pop()
                continue
            if tag in RAW:
                at = _RAW_ENDS[tag].search(page, at).end()
                if tag not in ("textarea", "title"):
                    held.append((" ", True))
                continue
            if tag == "br":
                held.append((" ", True))
                continue
            if tag == "hr":
                self._flush()
            if tag in VOID:
                continue
            if tag in BLOCKS:
                shut = CLOSES.get(tag, ())
                while self._frames[-1].get("p") or any(self._frames[-1].get(t) for t in shut):
                    self._pop()
                self._flush()
            state = max(_kind(tag, attrs, bool(self._scopes), any(self._open.get(t) for t in PROSE)), stack[-1].state)
            if tag in BLOCKS or state > stack[-1].state:  # other elements change nothing
                self._push(tag, state)
        while len(stack) > 1:
            self._pop()
        self._flush()

    def boxes(self) -> dict[int, bool]:
        """Hashes of the subtrees that recurrence may delete, those with at most half of the text that may stay, and whether they are marked."""
        return {h - (1 << 63): marked for h, marked, _, shown, _, _ in self.subtrees if 2 * shown <= self.shown}

    def cut(self, template: frozenset | set | dict = frozenset()) -> tuple[set[int], int]:
        """(blocks of template subtrees, characters in them)."""
        gone: set[int] = set()
        at, size = -1, 0
        for h, _, chars, shown, first, after in sorted(self.subtrees, key=lambda s: (s[4], -s[5])) if template else ():
            if after > at and 2 * shown <= self.shown and h - (1 << 63) in template:
                if first >= at:
                    size += chars
                gone.update(range(max(first, at), after))
                at = after
        return gone, size

    def text(self, gone: set[int] | frozenset = frozenset()) -> str:
        left = [b for k, b in enumerate(self.blocks) if k not in gone]
        for inside, most in ((True, HEADER), (True, SPARE), (False, HEADER), (False, SPARE)):  # the article; an article below a marked element; the page
            some = [(scope, text) for scope, state, text in left if state <= most and (scope > 0 or not inside)]
            if some:
                best = max(scope for scope, _ in some)
                return "\n".join(text for scope, text in some if scope == best)
        return ""


def main_text(page: str | None, template: frozenset | set = frozenset()) -> str:
    """Text of the article: blocks of <main>, else of <article>, else of the page, without template subtrees; null: empty."""
    return page_text(page, template)[0]


def page_text(page: str | None, template: frozenset | set | dict = frozenset()) -> tuple[str, int]:
    """(text of the article, characters that went as template)."""
    if not page:
        return "", 0
    read = Page(page)
    gone, size = read.cut(template)
    return read.text(gone), size


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = LEAST, root: float = ROOT) -> DataFrame:
    """(host, template): hashes of subtrees on many distinct pages of the host; copies of a page count once, ties at the threshold are template."""
    small_batches(pages.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, whole, found, marks = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                read = Page(page) if page else None
                own = [*read.boxes().items(), (None, None)] if read is not None else []  # a row without a subtree stands for the page
                found.extend(h for h, _ in own)
                marks.extend(m for _, m in own)
                hosts.extend([host] * len(own))
                whole.extend([read.hash - (1 << 63)] * len(own) if own else [])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(found, pa.int64()), pa.array(marks, pa.bool_())], ["host", "page", "subtree", "marked"])

    rows = pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, page bigint, subtree bigint, marked boolean").distinct()
    counted = rows.groupBy("host", "subtree", "marked").agg(F.count("*").alias("n"))
    sizes = counted.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    many = counted.where(F.col("subtree").isNotNull() & (F.col("n") >= least)).join(sizes, "host").where(F.col("marked") | (F.col("n") >= root * F.sqrt("pages")))
    return many.groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("template"))


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text``, ``n_chars`` and ``n_template``, the characters that went as template; null html gives an empty text.

    One row out per row in, repeated rows included; null urls count as one host; other columns are ignored; an empty table
    gives no rows. White space inside a block becomes one blank, blocks are joined by line feeds. Pages of any length and
    nesting are read whole, in linear time.
    """
    found = scratch.save(templates(pages), "templates")
    if scratch.size("templates") <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = pages.select("page_id", "url", "html", host_of().alias("host")).join(found, "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, frozenset] = {}
            texts, sizes = [], []
            for page, hashes in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                key = tuple(hashes or ())
                text, size = page_text(page, sets.setdefault(key, frozenset(key)))
                texts.append(text), sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_template bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), Scratch(spark, "html"))
