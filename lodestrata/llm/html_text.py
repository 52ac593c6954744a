"""HTML extraction with nearest-URL page differencing.

Each page becomes lines, one for each block of visible text, in zones: main (inside an article or main element), frame (what
is marked as navigation, header, footer, form, advert, comment and the like) or open. Pages are paired within their host with
the page of the nearest URL path whose lines differ, however many equal pages lie between; the two are aligned by the longest
common subsequence of their lines, and shared lines are deleted. Shared lines of the main zone stay, for two articles may
quote one passage. An exact check by markup follows: lines of the frame that no neighbour shares go too. Line hashes are
sorted and paired, not texts; texts are compressed and moved once, to meet the lines to delete."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .url_filters import url_parts

FRAME, OPEN, MAIN = range(3)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")  # the separators U+001C to U+001F are no white space
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg")}
_GONE_BLOCKS = frozenset("nav header footer aside form head dialog menu".split())
_GONE = _GONE_BLOCKS | frozenset("select button object audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _GONE_BLOCKS | _HEADINGS | frozenset("p div li ul ol dl dt dd table thead tbody tr caption section article main blockquote pre hr figure figcaption address details summary fieldset body html center".split())
#: Elements that a new one ends, and those it doesn't look beyond.
_ENDED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "body": (frozenset(("head",)), frozenset()),
}
_P, _P_BOUNDS = frozenset(("p",)), frozenset("td th table caption object button".split())
#: Whole class names and ids by which an element is no content; those of pages' headers count outside the main zone only.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising ad-banner ad-container ad-slot ad-wrapper adsbygoogle sponsor sponsored sponsored-content promo "
    "banner cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice site-notice popup modal overlay sidebar side-bar left-sidebar right-sidebar widget-area "
    "menu main-menu nav-menu site-menu navbar navigation main-navigation site-navigation nav main-nav site-nav breadcrumb breadcrumbs comment comments comment-list comments-list comments-area comments-section comment-section comment-form reader-comments user-comments disqus disqus_thread "
    "footer site-footer page-footer share share-buttons sharing social social-share social-links newsletter newsletter-signup subscribe signup login login-form search-form pagination pager".split()
)
_HEADERS = frozenset(("header", "masthead", "site-header", "page-header", "top-bar"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())


def _marks(attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is no content, and whether it is the main one, by its attributes."""
    if "=" not in attrs and "hidden" not in attrs:
        return False, False
    found = {k.lower(): (a or b or d or "").lower() for k, a, b, d in _ATTR.findall(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    gone = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _ROLES or not _NAMES.isdisjoint(names) or "display:none" in found.get("style", "").replace(" ", "")
    gone = gone or not in_main and not _HEADERS.isdisjoint(names)
    return gone, found.get("role") == "main" or found.get("itemprop") == "articlebody"


class _Reader:
    """Lines and zones of a page. Open elements are on a stack, so that an element that is not closed ends with the ones around it."""

    def __init__(self):
        self.lines: list[str] = []
        self.zones: list[int] = []
        self.held: list[str] = []
        self.open: list[tuple] = []  # tag, frame and main before it, text held before it
        self.frame = self.main = False

    def flush(self) -> None:
        if self.held:
            text = _WHITE.sub(" ", unescape("".join(self.held)).replace("\0", "\ufffd")).strip(" ")
            self.held = []
            if text:
                self.lines.append(text)
                self.zones.append(FRAME if self.frame else MAIN if self.main else OPEN)

    def end(self, n: int) -> None:
        """Ends open elements till n are left."""
        while len(self.open) > n:
            tag, frame, main, saved = self.open.pop()
            if tag in _BLOCKS or saved is not None or main != self.main:
                self.flush()
            if saved is not None:
                self.held = saved
            self.frame, self.main = frame, main

    def end_among(self, tags: frozenset, bounds: frozenset) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.end(k)
                return
            if self.open[k][0] in bounds:
                return

    def start(self, tag: str, attrs: str) -> None:
        block = tag in _BLOCKS
        if block:
            self.flush()
            self.end_among(_P, _P_BOUNDS)
            if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
                self.end(len(self.open) - 1)
        if tag in _ENDED:
            self.end_among(*_ENDED[tag])
        if tag in ("br", "td", "th"):
            self.held.append(" ")
        if tag in _VOID or attrs.endswith("/"):
            return
        gone, is_main = _marks(attrs, self.main) if attrs else (False, False)
        gone = tag in _GONE and not (tag == "header" and self.main) or gone and tag not in ("html", "body")
        is_main = is_main or tag in _MAIN
        saved = None
        if gone and not self.frame and not block:
            saved, self.held = self.held, []
        elif is_main and not self.main and not block:
            self.flush()
        self.open.append((tag, self.frame, self.main, saved))
        self.frame, self.main = self.frame or gone, self.main or is_main

    def close(self, tag: str) -> None:
        """A closing tag ends the last such element, and all that is open in it; no inline one ends a block."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.end(k)
                return
            if tag not in _BLOCKS and self.open[k][0] in _BLOCKS:
                return


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page and the zone of each."""
    page = _Reader()
    at, end = 0, len(html or "")
    while at < end:
        m = _TOKEN.search(html, at)
        page.held.append(html[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            page.close(tag)
        elif tag in _RAW:
            if not m[3].endswith("/"):
                stop = _RAW[tag].search(html, at)
                at = stop.end() if stop else end
        else:
            page.start(tag, m[3])
    page.end(0)
    page.flush()
    return page.lines, page.zones


def main_text(lines: list[str], zones: list[int], gone: list[int]) -> list[str]:
    """The lines that stay: those of the main zone, and open ones that are not gone."""
    lost = set(gone)
    return [x for k, (x, z) in enumerate(zip(lines, zones)) if z == MAIN or z == OPEN and k not in lost]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where = defaultdict(list)
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where[b[j]].append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    middle = []
    node = nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


GROUP = 256  # consecutive runs of equal pages that are compared in one go
NEAR = 80  # percent of the characters of both pages: pages that share so much are copies of each other, not of one frame


def nearness(a: str | None, b: str | None) -> tuple[int, int]:
    """Folders, then characters, that two paths have in common."""
    both = commonprefix((a or "", b or ""))
    return both.count("/"), len(both)


def _only_shared(lines: list[int], sizes: list[int], others: list[int], other_sizes: list[int]) -> list[int] | None:
    """Positions of lines outside the main zone that both have; None where there are none or, for pages without a main zone,
    where they are near copies. Sizes are in characters, negative in the main zone."""
    shared = shared_lines(lines, others)
    if all(x >= 0 for x in sizes) and 100 * sum(sizes[i] for i in shared) >= NEAR * max(sum(map(abs, sizes)), sum(map(abs, other_sizes))):
        return None
    return [i for i in shared if sizes[i] >= 0] or None


def deleted_lines(pages: DataFrame) -> DataFrame:
    """row, gone: positions of the lines that a page shares with its neighbour.

    Pages in the order of host and path fall into runs of equal lines, numbered over all partitions. Of the run before and
    the one after, the one whose nearest path has more in common with the page's is the neighbour, or the other one where
    nothing is to be deleted by the first."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes = [], []
            for t in b.column(3):
                lines, zones = lines_of(t.as_py())
                out.append(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64).view(np.int64))
                sizes.append(np.array([-len(x) if z == MAIN else len(x) for x, z in zip(lines, zones)], np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], c.lists(out, pa.int64()), c.lists(sizes, pa.int32())], names=["row", "host", "path", "lines", "sizes"])

    host, path = url_parts()
    kept = "row long, host string, path string, lines array<long>, sizes array<int>"
    # written before it is dealt by range, which looks at its input twice
    keyed = c.materialize(pages.select("row", host.alias("host"), path.alias("path"), "html").mapInArrow(hashes, kept), "hashes")
    order = ("host", "path", "row")
    n = max(8, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, last = TaskContext.get().partitionId(), -1, None
        for b in batches:
            runs, heads, signs = [], [], []
            for h, x, y in zip(b.column(1).to_pylist(), b.column(3), b.column(4)):
                sign = xxhash.xxh3_64_intdigest(x.values.to_numpy().tobytes() + y.values.to_numpy().tobytes()) - (1 << 63)
                heads.append((h, sign) != last)
                run += heads[-1]
                last = h, sign
                runs.append(run)
                signs.append(sign)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part)), pa.array(runs, pa.int64()), pa.array(heads), pa.array(signs, pa.int64())], names=[*b.schema.names, "part", "at", "head", "sign"])

    ranked = c.materialize(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, f"{kept}, part long, at long, head boolean, sign long"), "pages")
    edge = F.struct("at", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("none"), "sign")
    edges = ranked.where("head").groupBy("part").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).orderBy("part").collect()  # a row for each partition
    offsets, total, last = [], -1, None
    for part, first, end in edges:
        same = last == tuple(first)[1:]
        offsets.append((part, total if same else total + 1, same))
        total, last = offsets[-1][1] + end["at"], tuple(end)[1:]
    ranked = ranked.join(F.broadcast(pages.sparkSession.createDataFrame(offsets, "part long, before long, goes_on boolean")), "part").withColumn("run", F.col("before") + F.col("at"))
    ends = ranked.groupBy("run").agg(F.max("path").alias("last_path")).withColumnRenamed("run", "end_run")
    runs = ranked.where("head and not (at = 0 and goes_on)").join(ends, F.col("run") == F.col("end_run"))
    # the runs next to a group's ends are in both groups
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("run") + d) / GROUP))
    dealt = runs.select("run", "host", "path", "last_path", "lines", "sizes", F.explode(F.array_distinct(near)).alias("grp"))
    aligned = "run long, path_before string, path_after string, gone_before array<int>, gone_after array<int>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def end() -> pa.RecordBatch:
            out = []
            for k, r in enumerate(held):
                if r["run"] // GROUP != r["grp"]:
                    continue
                sides = [held[j] if 0 <= j < len(held) and held[j]["host"] == r["host"] else None for j in (k - 1, k + 1)]
                gone = [x and _only_shared(r["lines"], r["sizes"], x["lines"], x["sizes"]) for x in sides]
                if any(gone):
                    out.append((r["run"], sides[0] and sides[0]["last_path"], sides[1] and sides[1]["path"], *gone))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=["run", "path_before", "path_after", "gone_before", "gone_after"])

        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["grp"] != r["grp"]:
                    yield end()
                    held = []
                held.append(r)
        if held:
            yield end()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for r in b.to_pylist():
                after = not r["gone_before"] or r["gone_after"] and nearness(r["path"], r["path_after"]) > nearness(r["path"], r["path_before"])
                gone.append(np.array(r["gone_after" if after else "gone_before"], np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), c.lists(gone, pa.int32())], names=["row", "gone"])

    found = c.materialize(dealt.repartition(n, "grp").sortWithinPartitions("grp", "run").mapInArrow(align, aligned), "aligned")
    own = ranked.select("row", "path", "run").dropDuplicates(["row"]).join(found, "run")
    return own.select("row", "path", "path_before", "path_after", "gone_before", "gone_after").mapInArrow(choose, "row long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages: its blocks in order, joined by an empty line.

    Null and empty pages have an empty text; null URLs are one host of their own. Equal rows give equal results: a page is
    compared with the nearest one whose lines differ; a page without a main zone keeps all open lines where only near copies
    stand beside it. White space in a block is one space, character references are decoded, nothing is cut off. Further
    columns are ignored; an empty table gives an empty result."""
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("row"))
    gone = c.materialize(deleted_lines(pages), "shared").withColumnRenamed("row", "gone_row")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], []
            for t in b.column(2):
                lines, zones = lines_of(t.as_py())
                texts.append(pa.compress("\0".join(lines).encode("utf-8", "surrogatepass"), "zstd", asbytes=True) if lines else b"")
                found.append((sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines) - 1, bytes(zones)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(texts, pa.binary()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["page_id", "url", "row", "lines", "size", "zones"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, size, zones, lost in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                lines = pa.decompress(raw, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\0") if raw else []
                out.append("\n\n".join(main_text(lines, list(zones), lost or [])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    lines = pages.mapInArrow(packed, "page_id long, url string, row long, lines binary, size long, zones binary")
    out = lines.join(gone, F.col("row") == F.col("gone_row"), "left")
    return out.select("page_id", "url", "lines", "size", "zones", "gone").mapInArrow(texts, "page_id long, url string, text string")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
