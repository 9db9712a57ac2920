"""Operator 2: main text of web pages by nearest-URL page differencing.

A page becomes text lines, one a block, in page order. Pages are ordered by URL path within each host and
each is paired with its nearest neighbours. A pair's lines are aligned by longest common subsequence (of lines
numbered by occurrence, so that the alignment is an increasing subsequence and takes n log n), and lines
shared by both are the site's frame and are deleted, wherever they stand: menus, headers, footers, notices
and whatever main elements repeat. Only lines inside an article element are never frame: a paragraph that two
articles quote stays. A neighbour beside which almost nothing of a page is left is a copy of it and gives no
evidence, however much the frame alone makes them share; beyond a run of copies the nearest page on each side
that is none takes its place. Equal pages of a host are one page in the ordering.

Markup decides what pages don't share: lines of menus, forms, comments and adverts that are a page's own are
no text, nor are lines outside of article and main elements and containers named as content on pages that
have such. Scripts, styles and the like are never lines.

The order within a host is made by a range partitioning of line hashes, so a host with a third of all
pages spreads over many tasks; the pairs across task borders are made from the first and last page of
each task, and from those pages of it whose run of copies reaches a border. Texts are parsed once and aren't shuffled by the pairing.

Defined cases: null html is an empty page; a null URL is host "" and path ""; repeated rows give a row
each; a page without a neighbour, or with copies as neighbours only, keeps all lines that its markup
doesn't rule out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialize, ship_package

FEW_PAGES = 200_000  # with deleted lines, whose numbers are broadcast; more meet the texts by shuffle
LEFT, LEFT_PART = 8, 0.05  # a neighbour beside which fewer characters, or a smaller part, of a page are left is a copy

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
# HTML element names by role, and names that sites give to page parts.
RAW = frozenset("script style title textarea iframe noscript noframes noembed template xmp svg math canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th".split())
PAGE_PARTS = frozenset("nav header footer aside form button select dialog menu".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PART_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
NEVER_MAIN = frozenset("ad ads advert adverts advertisement comment comments disqus related reply respond sidebar widget".split())


def _part(tag: str, attributes: str, inside: bool, named: bool = True) -> tuple[bool, int]:
    """Is the element a page part that is no article text? How surely is it the article (0 to 3)? Without
    named, the names that sites give to elements don't count."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = {p.lower() for k in ("id", "class") if k in found for p in _PARTS.split(found[k])} if found and named else set()
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in PART_ROLES:
        return True, 0
    if tag in PAGE_PARTS and not (tag == "header" and inside):
        return True, 0
    if names & NEVER_MAIN or names & PART_NAMES and not (names & MAIN_NAMES and tag not in ("ul", "ol")) and not (inside and names & PART_NAMES <= {"header"}):
        return True, 0
    if tag == "article":
        return False, 3
    if tag == "main" or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return False, 2
    return False, int(tag in ("div", "section", "td") and bool(names & MAIN_NAMES))


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The lines of a page that its markup doesn't rule out, in order, with their levels."""
    return [x for x in block_lines(html) if x[1] >= 0]


def block_lines(html: str | None, named: bool = True) -> list[tuple[str, int]]:
    """The lines of a page, in order, each with how surely it is the article's: 3 in an article element, 2 in
    a main one, 1 in a container named as content, else 0, and -1 in a part that is no article text."""
    if not html:
        return []
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, page part, article level; the last two with what is above
    dropped, level, at = False, 0, 0

    def flush() -> None:
        if buffer:
            line = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if line:
                out.append((line, -1 if dropped else level))

    while True:
        m = _TAG.search(html, at)
        if m is None or m.start() > at:
            buffer.append(html[at : m.start() if m else len(html)])
        if m is None:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "td", "th"):
            buffer.append(" ")
        if slash:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[1] != dropped or s[2] != level for s in stack[k - 1 : k]) or k == 0 and (dropped or level):
                        flush()
                    del stack[k:]
                    break
            dropped, level = stack[-1][1:] if stack else (False, 0)
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = len(html) if end is None else end.start()
        elif tag not in VOID:
            part, surely = _part(tag, attributes, level > 0, named)
            if surely >= 2 and not part:  # an unclosed menu or header ends where the article begins
                for k, s in enumerate(stack):
                    if s[0] in ("nav", "header"):
                        del stack[k:]
                        dropped, level = stack[-1][1:] if stack else (False, 0)
                        break
            elif tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if part != dropped or surely > level:
                flush()
            dropped, level = dropped or part, max(level, surely)
            stack.append((tag, dropped, level))
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two sequences of lines, each line numbered by occurrence."""
    def numbered(x: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for v in x:
            seen[v] = seen.get(v, 0) + 1
            out.append((v, seen[v]))
        return out

    place = {v: j for j, v in enumerate(numbered(b))}
    pairs = [(i, place[v]) for i, v in enumerate(numbered(a)) if v in place]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(last[n - 1] if n else -1)
        ends[n:n + 1] = [j]
        last[n:n + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def frame_of(a: dict, b: dict) -> list[int] | None:
    """The lines of page a that page b has too, in order, outside a's article elements; None if b is a copy."""
    pairs = shared_lines(a["hashes"], b["hashes"])
    text = [n if v >= 0 else 0 for n, v in zip(a["sizes"], a["levels"])]  # menus and the like don't tell copies apart
    size = sum(text)
    if size - sum(text[i] for i, _ in pairs) < max(LEFT, LEFT_PART * size):
        return None
    return [i for i, _ in pairs if a["levels"][i] < 3]


_LINES = "page_id long, url string, host string, path string, signature long, lines array<string>, hashes array<long>, sizes array<int>, levels array<int>"
_PAGE = "host string, path string, signature long, hashes array<long>, sizes array<int>, levels array<int>"


def parse_pages(pages: DataFrame, named: bool = True) -> DataFrame:
    ship_package(pages.sparkSession)
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    address = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                lines = block_lines(html, named)
                m = address.match(url or "")
                hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines]
                levels = [v for _, v in lines]
                least = 1 if any(v > 0 for v in levels) else 0  # lines below are no text whatever neighbours share
                key = xxhash.xxh64_intdigest(repr((hashes, levels))) - (1 << 63)
                rows.append(((m[1].rpartition("@")[2].lower() if m else ""), (m[2].rstrip("/") if m else url or ""), key, [t if v >= least else None for t, v in lines], hashes, [len(t) for t, _ in lines], levels))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["page_id", "url", "host", "path", "signature", "lines", "hashes", "sizes", "levels"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _LINES)


def frames(parsed: DataFrame) -> DataFrame:
    """(host, signature, frame): the line numbers that differencing deletes, of pages that lose any."""
    spark = parsed.sparkSession
    distinct = parsed.groupBy("host", "signature").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("hashes", "sizes", "levels")])
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = distinct.repartitionByRange(parts, "host", "path", "signature").sortWithinPartitions("host", "path", "signature")

    def deletions(a: dict, b: dict) -> Iterator[tuple[str, int, list[int]]]:
        if a["host"] == b["host"]:
            for x, y in ((a, b), (b, a)):
                if any(v < 3 for v in x["levels"]) and (f := frame_of(x, y)):
                    yield x["host"], x["signature"], f

    class Walk:
        """Pages of a task in order; deletions by the nearest page on each side that is no copy."""

        def __init__(self):
            self.first = self.turn = None  # the task's first page, and the first one of its host that is no copy of those before
            self.last = self.other = None  # the page before, and the nearest one before it that is no copy of it
            self.waiting: list[tuple[dict, bool]] = []  # a run of copies up to the last page; has it a page before that is none?
            self.unsettled: list[dict] = []  # pages with copies only in this task, of a host that other tasks may hold

        def settle_elsewhere(self) -> None:
            self.unsettled += [p for p, before in self.waiting if not before and any(v < 3 for v in p["levels"])]

        def step(self, page: dict) -> Iterator[tuple[str, int, list[int]]]:
            last, self.last = self.last, page
            if last is None or last["host"] != page["host"]:
                if last is None:
                    self.first = page
                elif last["host"] == self.first["host"]:
                    self.settle_elsewhere()
                self.other, self.waiting = None, [(page, False)]
                return
            before = frame_of(page, last)
            if before is not None:
                self.other = last
            elif self.other is not None:
                before = frame_of(page, self.other)
            if before:
                yield page["host"], page["signature"], before
            if frame_of(last, page) is not None:
                if page["host"] == self.first["host"] and self.turn is None:
                    self.turn = page
                for p, _ in self.waiting:
                    if f := frame_of(p, page):
                        yield p["host"], p["signature"], f
                self.waiting = []
            self.waiting.append((page, before is not None))

    page = pa.struct([("host", pa.string()), ("path", pa.string()), ("signature", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("levels", pa.list_(pa.int32()))])

    def batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        cols = [[r[0] for r in rows] + [None] * len(edges), [r[1] for r in rows] + [None] * len(edges), [r[2] for r in rows] + [None] * len(edges), [None] * len(rows) + [e[0] for e in edges], [None] * len(rows) + [e[1] for e in edges]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), page])], names=["host", "signature", "frame", "place", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk = TaskContext.get().partitionId(), Walk()
        for b in batches:
            yield batch([d for r in b.to_pylist() for d in walk.step(r)], [])
        if walk.first is not None:
            ends = [walk.first, walk.turn, walk.other, walk.last]
            walk.settle_elsewhere()
            yield batch([], [(5 * part + k, p) for k, p in enumerate(ends) if p is not None] + [(5 * part + 4, p) for p in walk.unsettled])

    out = materialize(ordered.select("host", "path", "signature", "hashes", "sizes", "levels").mapInArrow(run, f"host string, signature long, frame array<int>, place long, page struct<{_PAGE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>"))
    # The first and last page of each task, and next to its borders the first that is no copy; a border lies
    # between a last and the next first. Four rows a task at most.
    ends = out.where("place is not null and place % 5 < 4").select("place", "page")
    edges = ends.where("place % 5 in (0, 3)").withColumn("next", F.lead("page").over(Window.orderBy("place"))).where("place % 5 = 3 and next is not null")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [d for a, n in zip(b.column("page").to_pylist(), b.column("next").to_pylist()) for d in deletions(a, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.list_(pa.int32())])], names=["host", "signature", "frame"])

    # Runs of copies that fill a task look for a page beyond it, among the ends of tasks that hold the host.
    unsettled = out.where("place % 5 = 4").select("place", "page")
    hosts = unsettled.select("page.host").distinct()
    near = spark.sparkContext.broadcast([(r.place, r.page.asDict()) for r in ends.join(hosts, F.col("page.host") == F.col("host"), "left_semi").orderBy("place").collect()])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for place, p in zip(b.column("place").to_pylist(), b.column("page").to_pylist()):
                sides = [q for at, q in reversed(near.value) if at < place - 4], [q for at, q in near.value if at > place]
                for side in sides:
                    f = next((f for q in side if q["host"] == p["host"] and (f := frame_of(p, q)) is not None), None)
                    if f:
                        rows.append((p["host"], p["signature"], f))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.list_(pa.int32())])], names=["host", "signature", "frame"])

    within = out.where("place is null").select("host", "signature", "frame")
    found = within.unionByName(edges.mapInArrow(across, within.schema)).unionByName(unsettled.mapInArrow(beyond, within.schema))
    return found.groupBy("host", "signature").agg(F.array_distinct(F.flatten(F.collect_list("frame"))).alias("frame"))


def extract(pages: DataFrame, named: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_frame (lines deleted by differencing) for every row of pages."""
    parsed = materialize(parse_pages(pages, named))
    found = materialize(frames(parsed))
    found = F.broadcast(found) if found.count() <= FEW_PAGES else found
    kept = (
        parsed.select("page_id", "url", "host", "signature", "lines").join(found, ["host", "signature"], "left")
        .withColumn("numbered", F.transform("lines", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        .withColumn("kept", F.filter("numbered", lambda x: x["t"].isNotNull() & ~F.coalesce(F.array_contains("frame", x["i"]), F.lit(False))))
    )
    text = F.array_join(F.transform("kept", lambda x: x["t"]), "\n")
    return kept.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.coalesce(F.size("frame"), F.lit(0)).alias("n_frame"))


def op2_page_differencing(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
