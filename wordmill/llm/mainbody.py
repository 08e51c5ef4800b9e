"""Main body of pages: nearest-URL page differencing.

Pages are put in order of host and path. Each page's text lines (blocks) are aligned with those of
its ``NEIGHBOURS`` nearest pages of the host by longest common subsequence, and what is shared with
any of them is deleted: it is the site's, not the article's. The rest decides:

* the article's container is the element that directly holds most of what is left;
* an element that a shared line opens (a heading of comments or teasers) is a slot of the template,
  and nothing in it is of the article;
* the headline is the line left that the page's title repeats, else the container's first heading.

An exact check follows: blocks of links, captions, meta lines and requests to subscribe or write in
are taken out, and a formula sentence that two articles share is given back where it stands next to
lines left of the container, in an element like theirs.

Which pages are near: those before a page in the order, one of each path; at the beginning of a host
those after it. The order is a range partitioning by (host, path, page_id), so a hot host and even a hot
URL are spread over as many tasks as their size asks for. Pages at the edge of a range that have too few
neighbours there, and those of one URL of which a task would have to hold more than ``HELD``, are
set aside; a second pass gives them the neighbours that the tasks left at the edges of all
ranges (hashed lines only, two sets of ``NEIGHBOURS`` pages for each edge).

Defined results: null, empty and blank pages and those that hold only a message, filler or an
unfilled template have no rows; pages of one path, of the same text, or that share title and most of
the text aren't neighbours of each other; a page whose host has no other page is judged as it
stands; equal blocks of a page give one row; a null URL sorts as empty; repeated rows give their
blocks again; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.article import ASIDE, LINK_SHARE, aside, ends_sentence, owner
from wordmill.llm.html import Block, blocks_of, title_of
from wordmill.llm.residue import is_meta_line, page_kind
from wordmill.session import materialise

#: Pages that a page is aligned with.
NEIGHBOURS = 12
#: Pages of a task that wait in memory for neighbours.
HELD = 200
#: Share of a page's text that a page of the same title must have to count as its copy.
COPY_SHARE = 0.8

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that are one paragraph, heading or item whatever they hold.
_PARAGRAPHS = frozenset((*_HEADINGS, "p", "li", "blockquote", "q", "dl", "dd", "dt", "ul", "ol"))
#: Beginnings of requests whose wording differs from page to page.
_REQUEST = re.compile(r"(?:подпишитесь|подписывайтесь|подписаться|присылайте|пришлите|сообщайте|следите за|subscribe|sign up|follow us|send us)\b", re.I)


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence: equal beginnings and ends first, the middle
    after Hunt and Szymanski."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n -= 1
        m -= 1
    where: dict = {}
    for j in range(lo, m):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    ends: list[tuple[int, int]] = []  # (position in a, index of the one before)
    at: list[int] = []
    for i in range(lo, n):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            ends.append((i, at[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                at.append(len(ends) - 1)
            else:
                tails[k] = j
                at[k] = len(ends) - 1
    middle = []
    e = at[-1] if at else -1
    while e >= 0:
        middle.append(ends[e][0])
        e = ends[e][1]
    return [*range(lo), *middle[::-1], *range(n, len(a))]


class Page:
    """A page as it is aligned; ``hashed`` gives lines as 64-bit hashes, as pages of the second pass have them."""

    __slots__ = ("id", "host", "path", "html", "title", "blocks", "lines", "known")

    def __init__(self, page_id: int | None, host: str, path: str, html: str | None):
        self.id, self.host, self.path, self.html = page_id, host, path, html
        self.blocks = blocks_of(html) if html else []
        self.title = title_of(html) if html else ""
        self.lines: list = [b.text for b in self.blocks]
        self.known = frozenset(self.lines)

    def hashed(self) -> Page:
        import xxhash

        h = xxhash.xxh64_intdigest
        self.lines = [h(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in self.lines]
        self.known = frozenset(self.lines)
        return self

    @classmethod
    def of_lines(cls, path: str, title: str, lines: list[int]) -> Page:
        page = cls(None, "", path, None)
        page.title, page.lines, page.known = title, lines, frozenset(lines)
        return page


def shared_lines(page: Page, neighbours: list[Page]) -> list[bool]:
    """Which blocks of a page the alignment with any neighbour deletes; a line deleted in one place is
    deleted wherever the page repeats it."""
    lines = page.lines
    left = set(lines)
    n_text = sum(len(b.text) for b in page.blocks if b.link_share < LINK_SHARE)
    for n in neighbours:
        if n.path == page.path or n.lines == lines or left.isdisjoint(n.known):
            continue
        common = common_lines(lines, n.lines)
        if n.title == page.title and sum(len(page.blocks[k].text) for k in common if page.blocks[k].link_share < LINK_SHARE) > COPY_SHARE * n_text:
            continue
        left.difference_update([lines[k] for k in common])
    return [x not in left for x in lines]


def _headline(blocks: list[Block], title: str, rows: list[int]) -> int | None:
    folded = title.casefold()
    for k in rows:
        if folded.startswith(blocks[k].text.casefold()):
            rest = title[len(blocks[k].text) :].strip()
            if not rest or not rest[0].isalnum():
                return k
    return None


def article_rows(blocks: list[Block], title: str, shared: list[bool]) -> list[int]:
    """Blocks of the article, from what differencing left."""
    first: dict[int, int] = {}
    held: Counter = Counter()
    for k, b in enumerate(blocks):
        for e in b.ids:
            first.setdefault(e, k)
            held[e] += 1
    own = [b.ids[-1] if b.ids and held[b.ids[-1]] > 1 and b.path[-1] not in _PARAGRAPHS else owner(b) for b in blocks]
    # Slots that have a shared line for a heading, wherever they stand.
    slots = {e for e, k in first.items() if shared[k] and own[k] == e and blocks[k].path[-1] in _HEADINGS}
    plain = [b.link_share < LINK_SHARE and not aside(b) and not is_meta_line(b.text) for b in blocks]
    left = [k for k, b in enumerate(blocks) if not shared[k] and plain[k] and slots.isdisjoint(b.ids)]
    weight: dict[int, int] = {}
    for k in left:
        weight[own[k]] = weight.get(own[k], 0) + len(blocks[k].text)
    if not weight:
        return []
    container = max(weight, key=lambda e: (weight[e], -e))
    head = _headline(blocks, title, left)
    if head is None:
        head = next((k for k in left if container in blocks[k].ids and blocks[k].path[-1] in ("h1", "h2")), None)
    start = -1 if head is None else head
    kept = set()
    for k in left:
        b = blocks[k]
        if k < start or (container and container not in b.ids):
            continue
        at = b.ids.index(container) + 1 if container else 0
        inner = list(zip(b.ids[at:], b.path[at:]))
        if not any(name in ASIDE or (shared[first[e]] and name not in _PARAGRAPHS) for e, name in inner):
            kept.add(k)
    names = {blocks[k].path[-1:] for k in kept if own[k] == container} - {("h1",), ("h2",), ("h3",), ("li",)}
    formulas = {
        k
        for k, b in enumerate(blocks)
        if shared[k] and k > start and own[k] == container and plain[k] and b.path[-1:] in names and (k - 1 in kept or k + 1 in kept) and ends_sentence(b.text)
    }
    out = {k for k in kept | formulas if not _REQUEST.match(blocks[k].text) or ends_sentence(blocks[k].text)}
    return sorted(out if head is None else out | {head})


def main_body(page: Page, neighbours: list[Page]) -> list[str]:
    """Texts of the article's blocks."""
    if not page.blocks or page_kind(page.blocks, page.title) == "message":
        return []
    return [page.blocks[k].text for k in article_rows(page.blocks, page.title, shared_lines(page, neighbours))]


_ROW = "kind byte, page_id long, host string, path string, block_md5 string, text string, lines array<long>"
_TYPES = [pa.int8(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_BLOCK, _ASIDE, _EDGE = 0, 1, 2


def _block_rows(page_id: int, texts: list[str]) -> list[tuple]:
    return [(_BLOCK, page_id, None, None, hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest(), t, None) for t in dict.fromkeys(texts)]


class Stream:
    """One range of pages in order of (host, path): rows of blocks, of pages set aside, and of pages for the edges."""

    def __init__(self, neighbours: int = NEIGHBOURS, held: int = HELD):
        self.n, self.held = neighbours, held
        self.host: str | None = None
        self.hosts = 0
        self.done: OrderedDict[tuple, list[tuple]] = OrderedDict()

    def _start(self, host: str) -> None:
        self.host = host
        self.hosts += 1
        self.recent: list[Page] = []  # one page of each of the last paths
        self.opening: list[Page] = []  # and of the first
        self.waiting: list[Page] = []
        self.paths = 0
        self.short = False
        self.done.clear()

    def _decide(self, page: Page, near: list[Page]) -> list[tuple]:
        """Copies of one path have their blocks from one alignment."""
        key = (page.path, page.title, tuple(page.lines))
        texts = self.done.get(key)
        if texts is None:
            if len(self.done) > 50:
                self.done.popitem(last=False)
            texts = self.done[key] = main_body(page, near)
        return _block_rows(page.id, texts)

    def _set_aside(self) -> list[tuple]:
        self.short = True
        rows = [(_ASIDE, p.id, p.host, p.path, None, p.html, None) for p in self.waiting]
        self.waiting = []
        return rows

    def _end(self, last: bool) -> list[tuple]:
        """A host that may go on in the next range, or began in the one before, isn't known whole."""
        if self.host is None:
            return []
        rows: list[tuple] = []
        edge = last or self.hosts == 1
        if edge:
            rows += self._set_aside()
        for p in self.waiting:
            rows += self._decide(p, self.recent)
        if self.short or edge:
            seen: dict[str, Page] = {p.path: p for p in [*self.opening, *self.recent]}
            rows += [(_EDGE, None, self.host, p.path, None, p.title, p.hashed().lines) for p in seen.values()]
        return rows

    def add(self, page: Page) -> list[tuple]:
        if not page.blocks:
            return []
        rows: list[tuple] = []
        if page.host != self.host:
            rows += self._end(False)
            self._start(page.host)
        if not self.recent or self.recent[-1].path != page.path:
            self.paths += 1
            self.recent.append(page)
            if len(self.recent) > self.n + 1:
                self.recent.pop(0)
            if len(self.opening) <= self.n:
                self.opening.append(page)
        if self.paths <= self.n:
            self.waiting.append(page)
            if len(self.waiting) >= self.held:
                rows += self._set_aside()
            return rows
        for p in self.waiting:
            rows += self._decide(p, self.recent)
        self.waiting = []
        return rows + self._decide(page, self.recent)

    def end(self) -> list[tuple]:
        return self._end(True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def _first_pass(neighbours: int, held: int):
    def run(batches):
        stream = Stream(neighbours, held)
        for b in batches:
            rows: list[tuple] = []
            for values in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows += stream.add(Page(*values))
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        yield _batch(stream.end())

    return run


def _nearest(neighbours: int):
    """For each path that pages were set aside of, the pages nearest to it among those of all edges."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        edges: dict[str, tuple] = {}
        wanted: set[str] = set()
        for kind, path, title, lines in zip(*(t.column(c).to_pylist() for c in ("kind", "path", "text", "lines"))):
            if kind == _EDGE:
                edges.setdefault(path, (path, title, lines))
            else:
                wanted.add(path)
        order = sorted(edges)
        hosts, paths, near = [], [], []
        for path in sorted(wanted):
            at = bisect_left(order, path)
            here = [p for p in order[max(0, at - neighbours) : at + neighbours + 1] if p != path]
            mid = sum(p < path for p in here)
            lo = max(0, min(mid - neighbours // 2, len(here) - neighbours))
            hosts.append(key[0].as_py())
            paths.append(path)
            near.append([dict(zip(("path", "title", "lines"), edges[p])) for p in here[lo : lo + neighbours]])
        kind = pa.list_(pa.struct([("path", pa.string()), ("title", pa.string()), ("lines", pa.list_(pa.int64()))]))
        return pa.Table.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(near, kind)], ["host", "path", "near"])

    return run


def _second_pass(batches):
    for b in batches:
        rows: list[tuple] = []
        for page_id, host, path, html, near in zip(*(b.column(k).to_pylist() for k in range(5))):
            page = Page(page_id, host, path, html).hashed()
            rows += _block_rows(page_id, main_body(page, [Page.of_lines(n["path"], n["title"], n["lines"]) for n in near or ()]))
        yield _batch(rows).select(["page_id", "block_md5", "text"])


def main_blocks(pages: DataFrame, neighbours: int = NEIGHBOURS, held: int = HELD) -> DataFrame:
    """(page_id, block_md5, block) of the main body's blocks."""
    url = F.coalesce(F.col("url_norm"), F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", "")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "raw_html").where("raw_html is not null and page_id is not null")
    ordered = rows.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    first = materialise(ordered.mapInArrow(_first_pass(neighbours, held), _ROW), "mainbody")
    held_back = first.where(F.col("kind") == _ASIDE)
    # Paths and hashed lines only: what one host has here grows with its ranges, not with its pages.
    asked = held_back.select("kind", "host", "path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("lines")).distinct()
    edges = first.where(F.col("kind") == _EDGE).select("kind", "host", "path", "text", "lines").dropDuplicates(["host", "path"])
    near = asked.unionByName(edges).groupBy("host").applyInArrow(_nearest(neighbours), "host string, path string, near array<struct<path:string,title:string,lines:array<long>>>")
    second = held_back.select("page_id", "host", "path", "text").join(near, ["host", "path"], "left").select("page_id", "host", "path", "text", "near")
    again = second.mapInArrow(_second_pass, "page_id long, block_md5 string, text string")
    blocks = first.where(F.col("kind") == _BLOCK).select("page_id", "block_md5", "text").unionByName(again)
    return blocks.withColumnRenamed("text", "block")
