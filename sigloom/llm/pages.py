"""Main text of web pages, by differencing with the page of the nearest URL.

A page becomes lines, one per block of its markup.  Pages of one host are put in the order of their
paths, and those in a row that have the same lines count as one; each is paired with the neighbour of
other lines whose path shares most with its own, and the two sequences of lines are aligned by
a longest common subsequence.  Lines that both have belong to the site and are deleted, wherever they
stand outside the page's own article; inside an ``article`` or ``main`` element they stay, because
copies of an article would otherwise delete each other.
What one pair cannot show is decided by the markup: elements that by name or class hold
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
never give text and take no part in the alignment, and if a page has an article, only that gives
text.  A class counts by its full name, and never for an element that is or contains the page's body,
``main`` or ``article``.

Null html is empty: empty text.  A null or odd URL has an empty host and path and is paired among
its like.  A page that has no neighbour of other lines, or only such as share nearly all its lines,
loses no line.  Repeated rows keep one result each.

Of two neighbours equally near the one before counts.  Html of any length is parsed in time proportional
to it.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import by_batch, saved, shuffle_partitions

# HTML element names by their meaning, and class names of page furniture.
RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "title", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strong sub sup time tt u var".split()
)
FURNITURE = set("nav footer aside form button select dialog head menu fieldset".split())
FURNITURE_CLASSES = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer footer menu modal nav navbar navigation newsletter notice popup "
    "promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar "
    "widget "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle banner-ad "
    "breadcrumb-nav comment-form comment-list comment-section comments-area comments-list "
    "comments-section consent-banner cookie-banner cookie-bar cookie-consent cookie-notice "
    "cookie-popup dropdown-menu footer-links footer-menu footer-nav footer-widgets global-footer "
    "global-nav left-sidebar main-menu main-nav main-navigation menu-bar mobile-menu mobile-nav "
    "nav-bar nav-links nav-menu navbar-nav newsletter-form newsletter-signup page-footer "
    "popup-overlay primary-menu primary-nav related-articles related-links related-posts "
    "right-sidebar share-bar share-buttons share-links sidebar-left sidebar-right site-footer "
    "site-nav site-navigation social-icons social-links social-media social-share "
    "sponsored-content sub-menu top-nav widget-area".split()
)
HEADER_CLASSES = set("header global-header page-header site-header".split())
CONTENT = {"article", "main"}
#: Elements that are never furniture by class, nor is any element around them.
WHOLE = {"html", "body", *CONTENT}

#: Neighbours sharing at least this part of a page's lines are taken for copies of it.
COPY_SHARE = 0.9

# Nothing in these gives back what it took, so a match takes time in proportion to its length.  A name ends
# before a quote only where the tag would not end otherwise.
_REST = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
_OTHER = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>", re.S)
_NAMES = [re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)"), re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)")]
_TAG = re.compile(rf"{_NAMES[0].pattern}({_REST})>")
_SIGN = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


class Element:
    """An element and the one around it; ``marked`` where a class makes it furniture.

    ``near`` is the innermost marked element among it and those around it; ``hidden`` is set when the page
    has been read: whether it lies in a marked element that nothing has cleared.
    """

    __slots__ = ("name", "content", "furniture", "around", "marked", "near", "cleared", "hidden")

    def __init__(
        self, name: str, content: bool, furniture: bool, around: Element | None, marked: bool = False
    ):
        self.name, self.content, self.furniture = name, content, furniture
        self.around, self.marked = around, marked
        self.near: Element | None = self if marked else around and around.near
        self.cleared = self.hidden = False

    def clear(self) -> None:
        """Not furniture by class, nor is any element around it.  Beyond a cleared one all are."""
        x = self.near
        while x is not None and not x.cleared:
            x.cleared = True
            x = x.around and x.around.near


class Line:
    __slots__ = ("text", "owner")

    def __init__(self, text: str, owner: Element):
        self.text, self.owner = text, owner

    @property
    def tag(self) -> str:
        return self.owner.name

    @property
    def content(self) -> bool:
        return self.owner.content

    @property
    def furniture(self) -> bool:
        return self.owner.furniture or self.owner.hidden

    def digest(self) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.tag}\n{self.text}") - (1 << 63)


def class_names(attributes: str) -> set[str]:
    """The whole names in the attributes class, id and role."""
    found: set[str] = set()
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                found.update("".join(values).lower().split())
    return found


class Tags:
    """The tags of a page in order, in time proportional to its length whatever is broken in it.

    A tag that does not end costs a look at the rest of the page.  The first one that is met makes a table of
    where a tag ends that reads on from each sign (``<``, ``>`` or a quote), from the last to the
    first: a quote leads on to the sign behind its partner.  Later ones are looked up.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.signs: list[int] = []
        self.ends: list[int] | None = None

    def _closing(self, at: int) -> int:
        """Place of the ``>`` that ends a tag read from ``at`` on, or -1."""
        if self.ends is None:
            self.signs = [m.start() for m in _SIGN.finditer(self.html)]
            self.ends = [-1] * (len(self.signs) + 1)
            partner: dict[str, int] = {}
            for k in range(len(self.signs) - 1, -1, -1):
                sign = self.html[self.signs[k]]
                if sign == ">":
                    self.ends[k] = self.signs[k]
                elif sign == "<":
                    self.ends[k] = self.ends[k + 1]
                else:
                    other = partner.get(sign)
                    self.ends[k] = -1 if other is None else self.ends[other + 1]
                    partner[sign] = k
        return self.ends[bisect_left(self.signs, at)]

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """Start and end of the next tag from ``at`` on; its name (None: comment and the like), whether it
        closes an element, and its attributes."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith(("<!", "<?"), at):
                if at < self.last or html.startswith("<!--", at):
                    m = _OTHER.match(html, at)
                    if m is not None:
                        return at, m.end(), None, False, ""
            elif at < self.last:
                if self.ends is None:
                    m = _TAG.match(html, at)
                    if m is not None:
                        return at, m.end(), m.group(2), bool(m.group(1)), m.group(3)
                for pattern in _NAMES:
                    m = pattern.match(html, at)
                    end = self._closing(m.end()) if m is not None else -1
                    if end >= 0:
                        return at, end + 1, m.group(2), bool(m.group(1)), html[m.end() : end]
            at += 1
        return None


def lines(html: str) -> list[Line]:
    """The blocks of a page that have text, in page order."""
    out: list[Line] = []
    stack = [Element("", False, False, None)]
    elements, opened_names = list(stack), Counter([""])
    tags, parts = Tags(html), []
    at, n = 0, len(html)

    def pop() -> str:
        name = stack.pop().name
        opened_names[name] -= 1
        return name

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Line(text, stack[-1]))

    while at < n:
        tag = tags.next(at)
        if tag is None:
            parts.append(html[at:])
            break
        start, end, name, closes, attributes = tag
        parts.append(html[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closes:
            # Inline elements are open only as furniture, or inside such of their name.
            if opened_names[name] > 0:
                close()
                while pop() != name:
                    pass
            elif name not in VOID and name not in INLINE:
                close()
            continue
        if name in RAW:
            ending = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I)
            m = ending.search(html, at, max(at, tags.last + 1))
            at = m.end() if m else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        names = class_names(attributes) if name not in WHOLE else ()
        by_class = not FURNITURE_CLASSES.isdisjoint(names)
        furniture = name in FURNITURE
        if name in INLINE and not by_class and not opened_names[name]:
            continue
        if name == "hr" or name not in VOID:
            close()
        if name in VOID:
            continue
        top = stack[-1].name
        if top == "p" and name not in INLINE or top == name and name in ("li", "dt", "dd", "tr", "td"):
            pop()
        around = stack[-1]
        if name in WHOLE:
            around.clear()
        furniture = furniture or name == "header" and not around.content
        by_class = by_class or not around.content and not HEADER_CLASSES.isdisjoint(names)
        opened = Element(
            name,
            around.content or name in CONTENT,
            around.furniture or furniture,
            around,
            by_class,
        )
        elements.append(opened)
        stack.append(opened)
        opened_names[name] += 1
        if attributes.endswith("/"):
            pop()
    close()
    for x in elements[1:]:
        x.hidden = x.around.hidden or x.marked and not x.cleared
    return out


def location(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    m = _URL.match(url or "")
    return (m.group(1).lower(), m.group(2) or "/") if m else ("", "")


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence.

    Matching positions are turned into a longest increasing run (Hunt and Szymanski), after equal
    beginnings and ends are taken off.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    tops: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def nearness(path: str, other: str) -> tuple[int, int]:
    """Equal leading segments of two paths, then equal leading characters."""

    def equal(a, b) -> int:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    return equal(path.split("/"), other.split("/")), equal(path, other)


def _listed(batch) -> dict[str, list]:
    places = [location(u) for u in batch.column("url").to_pylist()]
    found = [lines(h or "") for h in batch.column("html").to_pylist()]
    return {
        "key": batch.column("key"),
        "version": batch.column("version"),
        "host": [p[0] for p in places],
        "path": [p[1] for p in places],
        "lines": [[x.digest() for x in page if not x.furniture] for page in found],
    }


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pages with ``content``, a digest of their lines, and the number of their run of equals."""
    last, run = None, -1
    for batch in batches:
        contents, runs = [], []
        for host, found in zip(batch.column("host").to_pylist(), batch.column("lines").to_pylist()):
            content = xxhash.xxh3_128_hexdigest(array("q", found).tobytes())
            if (host, content) != last:
                last, run = (host, content), run + 1
            contents.append(content)
            runs.append(run)
        yield batch.append_column("content", pa.array(contents, pa.string())).append_column(
            "run", pa.array(runs, pa.int64())
        )


def _aligned(batch) -> dict[str, list]:
    """For a run of equal pages the lines shared with the one before and the one after.

    Null where there is none on the host, or where it shares so much that it is a copy.
    """
    out = {"pos": batch.column("pos")}
    for side in ("before", "after"):
        out[f"{side}_path"], out[f"{side}_shared"] = [], []
    for row in batch.to_pylist():
        for side in ("before", "after"):
            other, found = row[side], None
            if other is not None and other["host"] == row["host"]:
                found = common_subsequence(row["lines"], other["lines"])
                if len(found) >= COPY_SHARE * len(row["lines"]):
                    found = None
            out[f"{side}_path"].append(other["path"] if found is not None else None)
            out[f"{side}_shared"].append(found)
    return out


def _shared(batch) -> dict[str, list]:
    out = {"key": batch.column("key"), "version": batch.column("version"), "shared": []}
    for row in batch.to_pylist():
        near = [
            (nearness(row["path"], row[f"{side}_path"]), -k, row[f"{side}_shared"])
            for k, side in enumerate(("before", "after"))
            if row[f"{side}_shared"] is not None
        ]
        out["shared"].append(max(near, key=lambda x: x[:2])[2] if near else [])
    return out


def shared_lines(keyed: DataFrame) -> DataFrame:
    """(key, version, shared): which of a page's lines its nearest neighbour of other lines has too.

    Furniture lines are not counted.  Only digests of lines are sorted and moved.  Pages are ordered
    by range partitions; runs of equal pages are numbered through with one row per partition, aligned
    with the runs before and after, and what was found goes back to the pages by run and
    partition, so that a long run is not brought together.
    """
    spark = keyed.sparkSession
    order = ["host", "path", "key", "version"]
    listed = by_batch(
        keyed, "key long, version long, host string, path string, lines array<long>", _listed
    ).where(F.size("lines") > 0)
    ranged = saved(
        listed.dropDuplicates(["key", "version"])
        .select(*order, "lines")
        .repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _numbered,
            "host string, path string, key long, version long, lines array<long>, content string, "
            "run long",
        )
        .withColumn("part", F.spark_partition_id()),
        "pages",
    )
    page = F.struct("host", "content")
    ends = (
        ranged.groupBy("part")
        .agg(
            F.max("run").alias("last"),
            F.min_by(page, "run").alias("head"),
            F.max_by(page, "run").alias("tail"),
        )
        .orderBy("part")
        .collect()
    )
    offsets, total, tail = [(-1, 0)], 0, None
    for row in ends:  # one row per partition
        first = total - (row["head"] == tail)  # a run may go on in the next partition
        offsets.append((row["part"], first))
        total, tail = first + row["last"] + 1, row["tail"]
    starts = spark.createDataFrame(offsets, "part int, first long")
    placed = ranged.join(starts, "part").withColumn("pos", F.col("first") + F.col("run"))
    runs = saved(
        placed.groupBy("pos").agg(
            F.first("host").alias("host"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
            F.first("lines").alias("lines"),
        ),
        "runs",
    )
    before = runs.select(
        (F.col("pos") + 1).alias("pos"),
        F.struct("host", F.col("last_path").alias("path"), "lines").alias("before"),
    )
    after = runs.select(
        (F.col("pos") - 1).alias("pos"),
        F.struct("host", F.col("first_path").alias("path"), "lines").alias("after"),
    )
    aligned = by_batch(
        runs.select("pos", "host", "lines").join(before, "pos", "left").join(after, "pos", "left"),
        "pos long, before_path string, before_shared array<int>, after_path string, "
        "after_shared array<int>",
        _aligned,
    )
    held = placed.select("pos", "part").distinct().join(aligned, "pos")
    return by_batch(
        placed.select("pos", "part", "path", "key", "version").join(held, ["pos", "part"]),
        "key long, version long, shared array<int>",
        _shared,
    )


def main_text(html: str, shared: list[int]) -> str:
    """The text without the lines whose positions are ``shared``."""
    return _main_text(lines(html), set(shared))


def _main_text(found: list[Line], gone: set[int]) -> str:
    own = [x for k, x in enumerate(found) if not x.furniture and (x.content or k not in gone)]
    if any(x.content for x in own):
        own = [x for x in own if x.content]
    return "\n\n".join(x.text for x in own)


def _extracted(batch) -> dict[str, list]:
    out = {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": []}
    marks = batch.column("shared").to_pylist()
    for html, shared in zip(batch.column("html").to_pylist(), marks):
        found = lines(html or "")
        plain = [k for k, x in enumerate(found) if not x.furniture]
        out["text"].append(_main_text(found, {plain[k] for k in shared or []}))
    return out | {"n_chars": [len(t) for t in out["text"]]}


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length for every page."""
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        F.coalesce("page_id", F.lit(-(2**63))).alias("key"),
        F.xxhash64("url", "html").alias("version"),
    )
    found = shared_lines(keyed.select("key", "version", "url", "html"))
    return by_batch(
        keyed.join(found, ["key", "version"], "left").select("page_id", "url", "html", "shared"),
        "page_id long, url string, text string, n_chars long",
        _extracted,
    )
