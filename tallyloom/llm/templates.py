"""Main text of web pages: site templates are found by counting element subtrees per host, and removed.

Every block element of a page is hashed with all it contains. Spark counts on how many different pages of its host a
subtree stands; what recurs on many of them is template and is deleted with all it contains. Elements that name
their purpose (nav, footer, forms, classes such as ``ad`` or ``reader-comments``, unless they hold an article, main or h1) go as well, so that the few pages of
a small host come out clean too. Inside ``article`` or ``main`` only containers can be template: a paragraph that many
articles quote stays. The text is that of the articles if there are any, else of ``main``, else of the body.

A page is known by its host and the hash of its html, so equal pages count once, and a hot host is one key of a partial
aggregate. Pages themselves are not shuffled.

Edge cases: a null or empty html has the empty text; a null url, or one without a host, belongs to the empty host;
repeated rows come out alike; an empty table gives an empty result; unclosed elements end with the page, a tag with an
unclosed quote at the next ``>``; input
columns named like an added one are replaced.
"""
from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.arrow import small_batches
from tallyloom.llm.common import broadcast_below
from tallyloom.llm.urls import url_host
from tallyloom.plans.small import materialize

MIN_PAGES = 8
MIN_SHARE = 0.3
MAX_HOSTS = 20_000  # hosts whose templates are broadcast

#: Kinds of elements of HTML, and words of class, id and role that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section nav ul ol dl table header footer aside form menu details fieldset figure".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre address figcaption summary legend "
                        "tbody thead tfoot hgroup center article main body html head".split())
DROPPED = frozenset("head nav header footer aside form menu noscript template svg iframe select button object canvas video "
                    "audio dialog map math".split())
FURNITURE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu "
                      "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice "
                      "alert popup modal overlay newsletter subscribe signup login share sharing social related "
                      "recommended comment comments reply replies disqus pagination pager toolbar skip".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
             "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "body": ("head",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/><]*)(?:((?:[^><\"']|\"[^\"]*+\"|'[^']*+')*+)>|([^><]*+)>)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
#: First parts of names that tell a state of the page, not what the element is.
STATES = frozenset("no not has have with without is hide show".split())
HEARTS = ("article", "main", "h1")  # an element that is or holds one of these is never deleted for its name


def _names_furniture(attributes: str) -> bool:
    """Whether a whole name, or its last part, is a word of furniture."""
    for match in _NAMED.findall(attributes):
        for name in "".join(match).lower().split():
            parts = [x for x in _PARTS.split(name) if x]
            if parts and parts[-1] in FURNITURE and (len(parts) == 1 or parts[0] not in STATES):
                return True
    return False


class _Frame:
    __slots__ = ("tag", "blocks", "buffer", "parts", "dropped", "named", "hearts", "block")

    def __init__(self, tag, blocks, buffer, dropped, block, named=False, hearts=0):
        self.tag, self.blocks, self.buffer, self.dropped, self.block = tag, blocks, buffer, dropped, block
        self.named, self.hearts = named, hearts
        self.parts: list[str] = []


class Page:
    """One pass over a page: ``hashes`` of the subtrees that can be template, ``blocks`` of text that stay."""

    def __init__(self, html: str, template: frozenset[int] = frozenset()):
        self.template, self.hashes = template, set()
        self.blocks: list[tuple[str, str]] = []  # landmark ('article', 'main' or '') and text
        self.buffer: list[str] = []
        self.depth = {"article": 0, "main": 0}
        self.seen = {"article": False, "main": False}
        self.hearts = 0  # how many of HEARTS have been opened
        self.stack = [_Frame("", 0, 0, False, True)]
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            if m[3]:
                (self._close_tag if m[2] else self._open)(m[3].lower(), m[4] if m[5] is None else m[5])
        if at < len(html):
            self._text(html[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.buffer.append(text)
        if text := text.strip():
            self.stack[-1].parts.append(text)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append(("article" if self.depth["article"] else "main" if self.depth["main"] else "", text))
            self.buffer.clear()

    def _open(self, tag: str, attributes: str) -> None:
        block = tag in CONTAINERS or tag in TEXT_BLOCKS
        if block:
            while self.stack[-1].tag == "p" or self.stack[-1].tag in CLOSED_BY.get(tag, ()):
                self._pop()
            self._flush()
        elif tag in ("br", "hr"):
            self.buffer.append(" ")
        if tag in VOID or attributes.endswith("/") and not block:
            return
        landmark = tag in ("article", "main", "body", "html")
        dropped = tag in DROPPED
        named = "=" in attributes and tag not in ("body", "html") and _names_furniture(attributes)
        if not block and not dropped and not named:
            return
        before = self.hearts
        if tag in HEARTS and not any(f.dropped for f in self.stack):
            self.hearts += 1
        if landmark and tag in self.depth:
            self.depth[tag] += 1
            self.seen[tag] |= not dropped and not any(f.dropped for f in self.stack)
        self.stack.append(_Frame(tag, len(self.blocks), len(self.buffer), dropped, block, named, before))

    def _close_tag(self, tag: str, _: str) -> None:
        if any(f.tag == tag for f in self.stack):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()
        elif tag in CONTAINERS or tag in TEXT_BLOCKS:
            self._flush()

    def _pop(self) -> None:
        if self.stack[-1].block:
            self._flush()
        frame = self.stack.pop()
        if frame.tag in self.depth:
            self.depth[frame.tag] -= 1
        inside = self.depth["article"] or self.depth["main"]
        gone = frame.dropped or frame.named and self.hearts == frame.hearts
        if frame.parts:
            digest = xxhash.xxh3_64_intdigest(f"{frame.tag}\x1e" + "\x1f".join(frame.parts)) - (1 << 63)
            self.stack[-1].parts.append(f"{digest:x}")
            if frame.tag in CONTAINERS or not inside and frame.tag not in ("article", "main", "body", "html", "head"):
                self.hashes.add(digest)
                gone = gone or digest in self.template
        if gone:
            del self.blocks[frame.blocks:]
            del self.buffer[frame.buffer:]

    def text(self) -> str:
        kept = "article" if self.seen["article"] else "main" if self.seen["main"] else None
        return "\n".join(t for where, t in self.blocks if kept in (None, where))


def _subtrees(htmls: pa.Array) -> pa.Array:
    return pa.array([sorted(Page(h.as_py()).hashes) if h.is_valid else [] for h in htmls], pa.list_(pa.int64()))


def _texts(htmls: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([Page(h.as_py() or "", frozenset(t.as_py() or ())).text() for h, t in zip(htmls, templates)], pa.string())


def host_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
                   min_share: float = MIN_SHARE) -> DataFrame:
    """``host`` and ``template``: the hashes of the subtrees that stand on at least ``min_pages`` different pages of the host
    and on at least the share ``min_share`` of them. So a host has at most 1 / ``min_share`` times as many of them as its
    pages have elements, however many pages it has."""
    small_batches(pages.sparkSession)
    own = (pages.select(url_host(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
           .select("host", "page", F.arrow_udf(_subtrees, "array<bigint>")("html").alias("subtrees"))
           .groupBy("host", "page").agg(F.any_value("subtrees").alias("subtrees")))
    trees = own.select("host", F.explode("subtrees").alias("subtree"))
    sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    common = (trees.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_pages)
              .join(sizes, "host").where(F.col("c") >= F.lit(min_share) * F.col("n")))
    return common.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` without ``html``, with ``text`` (blocks in page order, one per line) and ``n_chars``. The templates, a row per
    host, are written once and broadcast if they are few; else the pages are joined to them by host."""
    found = materialize(host_templates(pages, url, html, min_pages, min_share), "host-templates").select(
        F.col("host").alias("__host"), F.col("template").alias("__template"))
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*rest, F.col(html).alias("__html"), url_host(F.col(url)).alias("__h"))
    joined = rows.join(broadcast_below(found, MAX_HOSTS), F.col("__h") == F.col("__host"), "left")
    return (joined.withColumn("text", F.arrow_udf(_texts, "string")("__html", "__template"))
            .select(*rest, "text").withColumn("n_chars", F.length("text").cast("long")))
