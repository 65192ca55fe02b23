"""The main text of web pages, without what their site repeats.

Every element's subtree is hashed (tag, attributes, text and children's hashes). Spark
counts on how many pages of a host each subtree occurs; subtrees on TEMPLATE_SHARE of a
host's pages are the site's template and are deleted. It takes TEMPLATE_PAGES pages to
tell: two that share a paragraph may be copies. What is
furniture by name on a single page, menus, forms, notices and the like, goes too, by
element, class, id and role. Left is the text of the page's articles, or of its main
part or body where there is no article.

Counts are summed per chunk before the exchange, so the page count of a host of any
size is a number. A host's template subtrees are at most the mean number of elements of
its pages / TEMPLATE_SHARE; they are joined to its pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

TEMPLATE_SHARE = 0.5
TEMPLATE_PAGES = 3

# Elements of HTML by their part in a page, and names that sites give to furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody tfoot thead tr ul""".split())
CELLS = frozenset("td th br".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table article section main div body aside nav select".split())
FURNITURE = frozenset("""head script style noscript template iframe object embed svg math canvas audio video form button select
option textarea input label fieldset nav menu aside footer dialog noframes title""".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
consent cookie cookies copyright disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices notification outbrain pager pagination paywall popup print promo promoted promotion recommended
related replies reply respond search share sharing shares sidebar signup skip social sponsor sponsored subscribe taboola
toolbar topbar widget widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def furniture(tag: str, attrs: str) -> bool:
    """Whether an element is no main text by its own names."""
    if tag in FURNITURE:
        return True
    if not attrs:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [p.lower() for p in PART.findall(word)]
                if not NAMES.isdisjoint(parts):
                    return True
        elif name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"}.isdisjoint(
                p.lower() for p in PART.findall(value)):
            return True
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


class Page:
    """Elements in order (parent, tag, furniture, subtree hash) and pieces of text between breaks."""

    def __init__(self, html: str):
        self.parent, self.tags, self.skip, self.hashes = [-1], [""], [False], [0]
        self.pieces: list[tuple[int, str | None]] = []  # (element, text), None for a break
        self.stack, self.parts = [0], [[]]
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        del self.parts

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            after = html[lt + 1:lt + 2]
            if after == "!" or after == "?":
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            if not (after.isalpha() and after.isascii()) and not (after == "/" and html[lt + 2:lt + 3].isalpha()):
                if after == "/" and lt + 2 < n:  # a stray end mark is a comment
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            m = TAG.match(html, lt) or LOOSE.match(html, lt)
            if m is None:
                return
            at, tag = m.end(), m.group(2).lower()
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, m.group(3))
            if tag in RAW:
                end = re.compile("</" + re.escape(tag) + r"[\s/>]", re.I).search(html, at)
                stop = n if end is None else end.start()
                self.parts[-1].append(xxhash.xxh64_digest(html[at:stop]))
                close = html.find(">", stop)
                at = n if close < 0 else close + 1
                self._close()

    def _text(self, text: str) -> None:
        if not text.isspace():
            self.parts[-1].append(text.strip().encode("utf-8", "surrogatepass"))
        self.pieces.append((self.stack[-1], text))

    def _break(self) -> None:
        self.pieces.append((self.stack[-1], None))

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CELLS:
            self.pieces.append((self.stack[-1], " "))
        if tag in BLOCKS:
            self._implied(("p",))
            self._break()
        if tag in CLOSES:
            self._implied(CLOSES[tag])
        if tag in VOID:
            self.parts[-1].append(tag.encode())
            return
        self.parent.append(self.stack[-1])
        self.tags.append(tag)
        self.skip.append(furniture(tag, attrs))
        self.hashes.append(0)
        self.stack.append(len(self.tags) - 1)
        self.parts.append([tag.encode("utf-8", "surrogatepass"), attrs.strip(" /\t\r\n").encode("utf-8", "surrogatepass")])

    def _implied(self, tags: tuple[str, ...]) -> None:
        """Ends open elements that this start ends, up to the next list, table or section."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in tags:
                while len(self.stack) > depth:
                    self._close()
                if len(tags) == 1:
                    return
            elif tag in SCOPES:
                return

    def _end(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                while len(self.stack) > depth:
                    self._close()
                break
        if tag in BLOCKS:
            self._break()

    def _close(self) -> None:
        element, parts = self.stack.pop(), self.parts.pop()
        digest = xxhash.xxh64_digest(b"\0".join(parts))
        self.hashes[element] = int.from_bytes(digest, "little")
        self.parts[-1].append(digest)
        if self.tags[element] in BLOCKS:
            self._break()

    def blocks(self, gone: list[bool], root: list[bool] | None) -> list[str]:
        out, held = [], []

        def flush():
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

        for element, text in self.pieces:
            if text is None:
                flush()
            elif not gone[element] and (root is None or root[element]):
                held.append(text)
        flush()
        return out

    def _below(self, marks: list[bool]) -> list[bool]:
        for i in range(1, len(marks)):
            marks[i] = marks[i] or marks[self.parent[i]]
        return marks

    def text(self, template: frozenset | set = frozenset()) -> str:
        """Blocks of the main text, one a line. Where the template would take all of it, the
        page is one of many copies and keeps it."""
        skip = list(self.skip)
        inside = self._below([t in ("article", "main") for t in self.tags])
        for i, t in enumerate(self.tags):
            if t == "header" and not inside[i]:
                skip[i] = True
        skip = self._below(skip)
        root = None
        for name in ("article", "main"):
            tops = [t == name and not s for t, s in zip(self.tags, skip, strict=True)]
            if any(tops):
                root = self._below(tops)
                break
        gone = self._below([s or h in template for s, h in zip(skip, self.hashes, strict=True)]) if template else skip
        return "\n".join(self.blocks(gone, root) or (self.blocks(skip, root) if template else []))


# ---- Spark -------------------------------------------------------------------------------

def host(url: str = "url") -> Column:
    """Lower-cased host of an address, without user and port; empty if there is none."""
    name = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def _count(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in bf.text_chunks(batches, "html"):
            hosts = bf.longs(rows, "host")
            keys, owner = [], []
            for i, html in enumerate(rows.column("html").to_pylist()):
                page = Page(html)
                own = {h for h, t in zip(page.hashes, page.tags, strict=True) if t not in ("", "html", "body")}
                keys += own
                owner.append(len(own))
            keys, where = np.array(keys, np.uint64), np.repeat(hosts, owner)
            o = np.lexsort((keys, where))
            keys, where = keys[o], where[o]
            at = bf.groups(where, keys)
            n, keys, where = np.diff(at).astype(np.uint32), keys[at[:-1]], where[at[:-1]]
            o, b = bf.by_bucket(bf.spread(keys ^ bf.mix(where.view(np.uint64).copy()), buckets), buckets)
            used = np.flatnonzero(np.diff(b))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "block": pa.array(
                [bf.pack(where[o[b[k]:b[k + 1]]], keys[o[b[k]:b[k + 1]]], n[o[b[k]:b[k + 1]]]) for k in used], pa.binary())})
    return run


def _sum(table: pa.Table) -> pa.Table:
    where, keys, n = bf.unpack_all(table["block"])
    o = np.lexsort((keys, where))
    at = bf.groups(where[o], keys[o])
    total = np.append(0, np.cumsum(n[o], dtype=np.int64))
    total = total[at[1:]] - total[at[:-1]]
    many = total >= TEMPLATE_PAGES
    first = o[at[:-1]][many]
    return pa.table({"host": where[first], "subtree": keys[first].view(np.int64), "n": total[many]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, subtrees): hashes of what recurs over a host's pages; pages: host (a hash), html."""
    buckets = bf.bucket_count(pages.sparkSession, 1)
    found = (pages.select("host", "html").mapInArrow(_count(buckets), "bucket int, block binary")
             .groupBy("bucket").applyInArrow(_sum, "host long, subtree long, n long"))
    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    often = found.join(size, "host").where(F.col("n") >= F.col("pages") * TEMPLATE_SHARE)
    return stored(often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "templates")


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple = (None, frozenset())
    for rows, _, _ in bf.text_chunks(batches, "html"):
        texts = []
        for html, h, subtrees in zip(rows.column("html").to_pylist(), rows.column("host").to_pylist(), rows.column("subtrees"), strict=True):
            if known[0] != h:
                known = (h, frozenset(x % (1 << 64) for x in subtrees.as_py() or ()))
            texts.append(Page(html).text(known[1]))
        yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by line breaks; empty if none), n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored. A null html is an
    empty page, with no text. Pages without a host in their url (null, relative) belong
    to one nameless host. Rows stand for themselves, repeated ones and rows without
    page_id too; each counts as a page of its host. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.xxhash64(host()).alias("host"), bf.whole_text("html"))
    return rows.join(templates(rows), "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
