"""Main text of pages, with nearest-URL page differencing.

A page is read into lines: the texts of its blocks, each marked as chrome (menus, forms, notices and their like), as
part of the article's own element, or as neither. Names of chrome count as whole tokens, and not for elements around an
article; between articles and elements named as content, the longer text decides. Pages are ordered by host and URL path;
a page's partner is the neighbour of the same host with the longer common path, copies and near copies of the page passed
over. The lines of both are aligned by their longest common subsequence, and lines they share are deleted as the site's
own: what stands on two pages in the same order is frame, what differs is content. Where a page names its article, that
element's lines are the text but for those that all different pages looked at, two at least, have in their frame and
nowhere else: articles may quote the same passage, so a line that one of them has in its own main text stays.

Pages of one host with equal lines are compared once. Where the shared lines are most of a page's text, only those that a
further page of the host has too are deleted.

The order is cut into sampled ranges over all hosts, with some edge pages per range, so one host may hold any
share of the pages, and a run of near copies any number of ranges. Only hashes of lines travel for the comparison.

Defined cases: a null or empty html has an empty text. A page without partner keeps all lines that are no
chrome, and so do copies and near copies on a host without any other page, because pages that share nearly all of
their lines say nothing about the frame. A null url is a host of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from waybridge.llm.common import batched, per_batch, stored
from waybridge.operators.ordered import sliced

#: Elements by what they do to text.
DROPPED = {"head", "title", "nav", "footer", "aside", "form", "fieldset", "menu", "dialog", "header"}
MUTED = {
    "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea",
    "option", "label", "audio", "video", "map", "math"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "img", "br"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class and id that name chrome, roles that do, and names of an article's element.
CHROME_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promoted",
    "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "widget"}
#: Words that only say where or in what box: a class or id is chrome if it consists of these and at least one of the above.
PLACES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "form", "global", "icons",
    "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "overlay", "page", "panel", "posts", "primary",
    "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
ARTICLE_NAMES = {
    "article", "article-body", "article-content", "content", "entry-content", "main", "main-content", "post",
    "post-body", "post-content", "story", "story-body"}
CHROME, PLAIN, NAMED, ARTICLE = 0, 1, 2, 3
#: Kind of an element that only its class or id names as chrome.
MAYBE = -1
#: An element named as chrome that holds an article of this share of the page's longest one is a layout around articles; pages
#: whose named elements hold less than this share of their text are read as if they named none.
LAYOUT_SHARE, NAMED_SHARE = 0.5, 1 / 3
_WORDS = re.compile(r"[a-z]+")
#: Pages are near copies if they share more than this of the longer one's text that is no chrome. Different pages that are looked
#: at on either side, and the share of a page's text beyond which a line must be found on two of them to be the site's.
NEAR_SHARE, PARTNERS, MOST_SHARE = 0.75, 3, 0.5
_LINES = pa.list_(pa.struct([
    ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("marks", pa.list_(pa.int8()))]))
ENDS = pa.schema([("_slice", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("heads", _LINES), ("tails", _LINES)])
CARRIED = pa.schema([("_slice", pa.int32()), ("before", _LINES), ("after", _LINES)])
SHARED = pa.schema([("host", pa.string()), ("sequence", pa.int64()), ("shared", pa.list_(pa.int32()))])


def names_chrome(names: str, inside: bool) -> bool:
    """Whether one of the class and id tokens names chrome. States such as has-sidebar or comments-open do not."""
    for token in names.split():
        words = set(_WORDS.findall(token))
        named = words & CHROME_WORDS or not inside and "header" in words
        if named and words <= CHROME_WORDS | PLACES | {"header"}:
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, node, whether it is all links) of a page's blocks.

    A node is an element that says something about its text: (node around it, kind).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool]] = []
        self.nodes: list[tuple[int, int]] = [(0, PLAIN)]
        # element, node around it, whether its own text is muted
        self.open: list[tuple[str, int, bool]] = []
        self.node, self.muted, self.said, self.linked, self.links = 0, 0, [], 0, 0

    def _break(self) -> None:
        text = " ".join("".join(self.said).split())
        if text:
            self.lines.append((text, self.node, self.linked > 0.8 * len(text)))
        self.said, self.linked = [], 0

    def _kinds(self, tag: str, attrs: dict) -> list[int]:
        """What an element says of its text, the outer kind first."""
        around = self.nodes[self.node][1]
        if around == CHROME:
            return []
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        role = (attrs.get("role") or "").lower()
        inside = around >= NAMED
        if tag in DROPPED and not (tag == "header" and inside) or role in CHROME_ROLES or "hidden" in attrs:
            return [CHROME]
        article = tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
        named = not article and bool(set(names.split()) & ARTICLE_NAMES)
        chrome = tag not in ("html", "body", "main") and names_chrome(names, inside) and not (named and not inside)
        kind = ARTICLE if article else NAMED if named and around < NAMED else None
        return [MAYBE] * chrome + [kind] * (kind is not None and kind != around)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.said.append(" ")
            return
        if tag not in INLINE and tag not in MUTED:
            self._break()
            if tag == "body":
                self._close("head")
            if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th"):
                self._close(tag, {"ul", "ol", "table", "dl", "div", "section", "article", "nav", "aside", "td", "th"} - {tag})
        if tag in VOID:
            return
        kinds = [CHROME] if tag in MUTED else self._kinds(tag, dict(attrs))
        if tag in INLINE or tag in MUTED:
            mute = bool({CHROME, MAYBE} & set(kinds)) and self.nodes[self.node][1] != CHROME
            self.open.append((tag, self.node, mute))
            self.muted += mute
            self.links += tag == "a"
            return
        if kinds:
            self._break()
        self.open.append((tag, self.node, False))
        for kind in kinds:
            self.nodes.append((self.node, kind))
            self.node = len(self.nodes) - 1

    def _close(self, tag: str, fence: frozenset | set = frozenset()) -> None:
        """Close the last open ``tag`` and all that is open in it, unless a fence lies between."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if self.open[at][1] != self.node:
                    self._break()
                self.links -= sum(t == "a" for t, _, _ in self.open[at:])
                self.muted -= sum(m for _, _, m in self.open[at:])
                self.node = self.open[at][1]
                del self.open[at:]
                return
            if self.open[at][0] in fence:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE and tag not in MUTED:
            self._break()
        self._close(tag)

    def handle_data(self, data):
        if self.muted:
            return
        self.said.append(data)
        if self.links:
            self.linked += len(data.strip())


def _marks(page: _Lines) -> list[int]:
    """Marks of a page's lines, from all its nodes."""
    nodes = page.nodes
    chains = []
    for k, (around, _) in enumerate(nodes):
        chains.append([*(chains[around] if k else []), k])
    kinds = [[nodes[k][1] for k in chain] for chain in chains]
    # text of outermost articles and named elements outside sure chrome, and the longest of them in each node
    size = [0] * len(nodes)
    for text, node, _ in page.lines:
        if CHROME not in kinds[node]:
            top = next((k for k in chains[node] if nodes[k][1] >= NAMED), None)
            if top is not None:
                size[top] += len(text)
    longest = list(size)
    for k in range(len(nodes) - 1, 0, -1):
        longest[nodes[k][0]] = max(longest[nodes[k][0]], longest[k])
    frame = [kind == CHROME or kind == MAYBE and (
        any(x >= NAMED for x in kinds[k][:-1]) or not longest[k] or longest[k] < LAYOUT_SHARE * longest[0])
        for k, (_, kind) in enumerate(nodes)]
    marks = []
    for text, node, links in page.lines:
        mark = CHROME if any(frame[k] for k in chains[node]) else max(kinds[node])
        marks.append(CHROME if mark == PLAIN and links else mark)
    return _chosen(page, chains, kinds, marks)


def _chosen(page: _Lines, chains: list, kinds: list, marks: list[int]) -> list[int]:
    """Marks in which the highest one is that of the main text: by amount of text, not by name."""
    total = [0, 0, 0, 0]
    parts: dict[tuple[int, int], int] = {}
    for (text, node, _), mark in zip(page.lines, marks):
        total[mark] += len(text)
        if mark >= NAMED:
            top = next(k for k, kind in zip(chains[node], kinds[node]) if kind == mark)
            parts[mark, top] = parts.get((mark, top), 0) + len(text)
    if total[NAMED] + total[ARTICLE] < NAMED_SHARE * sum(total[PLAIN:]):
        return [min(mark, PLAIN) for mark in marks]
    best = {m: max((n for (mark, _), n in parts.items() if mark == m), default=0) for m in (NAMED, ARTICLE)}
    if best[NAMED] <= best[ARTICLE]:
        return marks
    # the longest text stands in a named element: articles inside such belong to it, others are teasers beside it
    return [mark if mark < ARTICLE else NAMED if NAMED in kinds[node] else PLAIN
            for (_, node, _), mark in zip(page.lines, marks)]


def page_lines(html: str) -> list[tuple[str, int]]:
    """Texts of a page's blocks in page order, with their marks."""
    page = _Lines()
    page.feed(html)
    page.close()
    page._break()
    return [(text, mark) for (text, _, _), mark in zip(page.lines, _marks(page))]


def _lengths(a: list, b: list) -> list[int]:
    """Common subsequence lengths of ``a`` with every prefix of ``b``, by bit-parallel addition."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    bits = bin(~row & full | 1 << len(b))[3:][::-1]
    out, n = [0], 0
    for c in bits:
        n += c == "1"
        out.append(n)
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory that grows with their sum."""
    there = set(b)
    kept = [i for i, x in enumerate(a) if x in there]
    here = {a[i] for i in kept}
    b = [x for x in b if x in here]
    work, out = [(kept, b)], []
    while work:
        at, b = work.pop()
        low = 0
        while low < len(at) and low < len(b) and a[at[low]] == b[low]:
            out.append(at[low])
            low += 1
        at, b = at[low:], b[low:]
        while at and b and a[at[-1]] == b[-1]:
            out.append(at[-1])
            at, b = at[:-1], b[:-1]
        if not at or not b:
            continue
        if len(at) == 1:
            if a[at[0]] in b:
                out.append(at[0])
            continue
        half = len(at) // 2
        front = _lengths([a[i] for i in at[:half]], b)
        back = _lengths([a[i] for i in reversed(at[half:])], b[::-1])[::-1]
        cut = int(np.argmax(np.add(front, back)))
        work += [(at[:half], b[:cut]), (at[half:], b[cut:])]
    return sorted(out)


def pages_in_lines(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, path, lines, marks) of every page, written once."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [page_lines(h or "") for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
             pa.array([[m for _, m in f] for f in found], pa.list_(pa.int32()))], names=["page_id", "url", "lines", "marks"])

    rows = batched(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")).mapInArrow(
        per_batch(run), "page_id long, url string, lines array<string>, marks array<int>")
    place = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    return stored(rows.withColumn("host", F.lower(F.regexp_extract("url", place, 1))).withColumn(
        "path", F.regexp_extract("url", place, 2)).withColumn("row", F.monotonically_increasing_id()))


def line_hashes(rows: DataFrame) -> DataFrame:
    """Pages with hashes and marks of their lines, the lengths of those that are no chrome, and a hash of these and the highest mark."""
    sizes = F.zip_with("lines", "marks", lambda t, m: F.when(m > CHROME, F.length(t)).otherwise(0))
    out = rows.withColumn("hashes", F.transform("lines", lambda t: F.xxhash64(t))).withColumn("sizes", sizes).withColumn(
        "marks", F.col("marks").cast("array<byte>"))
    return out.withColumn("sequence", F.xxhash64("hashes", "sizes", F.array_max("marks"))).fillna({"host": "", "path": ""})


class _Page:
    """A page of a host's order: path, hashes of its lines, lengths of those that are no chrome, and marks."""

    def __init__(self, row: dict):
        self.path, self.hashes, self.sizes, self.marks = row["path"], row["hashes"], row["sizes"], row["marks"]
        self.weights: dict[int, int] = {}
        for h, n in zip(self.hashes, self.sizes):
            if n:
                self.weights[h] = self.weights.get(h, 0) + n
        self.total = sum(self.sizes)
        self.best = max(self.marks, default=CHROME)

    @functools.cached_property
    def text(self) -> set[int]:
        """Hashes of the lines that are the page's main text by their marks."""
        return {h for h, m in zip(self.hashes, self.marks) if m == self.best > CHROME}

    def near(self, other: _Page) -> bool:
        """Whether both are copies but for a small part of the longer one."""
        if min(self.total, other.total) <= NEAR_SHARE * max(self.total, other.total):
            return False
        common = sum(min(n, other.weights.get(h, 0)) for h, n in self.weights.items())
        return common > NEAR_SHARE * max(self.total, other.total)

    def row(self) -> dict:
        return {"path": self.path, "hashes": self.hashes, "sizes": self.sizes, "marks": self.marks}


def _remember(seen: list[_Page], page: _Page) -> list[_Page]:
    """The last pages that are no near copies of each other, the latest first. Pages without text of their own are no help."""
    return [page, *(p for p in seen if not p.near(page))][:PARTNERS] if page.total else seen


def _before(pages: list[tuple[str, _Page]], seen: list[_Page]) -> list[list[_Page]]:
    """For every page, in order, those that :func:`_remember` holds of its host; at last, those after the last page."""
    out, host = [], pages[0][0] if pages else None
    for h, page in pages:
        seen, host = (seen if h == host else []), h
        out.append(seen)
        seen = _remember(seen, page)
    return [*out, seen]


def _joined(near: list[_Page], far: list[_Page]) -> list[_Page]:
    return [*near, *(p for p in far if not any(p.near(x) for x in near))][:PARTNERS]


def _shared(page: _Page, others: list[_Page]) -> list[int]:
    """Places of the main text's lines that a page shares with the nearest of its host's different pages, ``others`` by distance.

    Where the page names its article, only those that at least two different pages have, all of them outside their own main text.
    """
    def common(side):
        n = min(len(page.path), len(side.path))
        return next((k for k in range(n) if page.path[k] != side.path[k]), n)

    different = [x for x in sorted(others, key=common, reverse=True) if not x.near(page)]
    if not different:
        return []
    partner = different[0]
    places = common_lines(page.hashes, partner.hashes)
    if sum(page.sizes[i] for i in places) > MOST_SHARE * page.total:
        # it may be a page of the same article, so only what a further page has too is the site's
        further = set().union(*(x.hashes for x in different[1:] if not x.near(partner)))
        places = [i for i in places if page.hashes[i] in further]
    places = [i for i in places if page.marks[i] == page.best > CHROME]
    if page.best > PLAIN:
        # a single page may quote an article in its frame, so several must agree
        frame = set.intersection(*(set(x.hashes) - x.text for x in different)) if len(different) > 1 else set()
        places = [i for i in places if page.hashes[i] in frame]
    return places


def _in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["host"], r["path"], r["row"]))


def _ends(table: pa.Table) -> pa.Table:
    """One row per slice: what it has for the slices before and after it."""
    rows = _in_order(table)
    pages = [(r["host"], _Page(r)) for r in rows]
    tails, heads = _before(pages, [])[-1], _before(pages[::-1], [])[-1]
    return pa.Table.from_pylist([{
        "_slice": rows[0]["_slice"], "first": rows[0]["host"], "last": rows[-1]["host"],
        "heads": [p.row() for p in heads], "tails": [p.row() for p in tails]}], schema=ENDS)


def _carried(batches):
    """What all earlier and all later slices have for each slice; some pages per slice come here."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["_slice"])

    def along(rows, side, first, last):
        host, seen, out = None, [], {}
        for r in rows:
            out[r["_slice"]] = seen if r[first] == host else []
            own = [_Page(p) for p in r[side]]
            seen = _joined(own, seen) if r[first] == r[last] == host else own
            host = r[last]
        return out

    before, after = along(rows, "tails", "first", "last"), along(rows[::-1], "heads", "last", "first")
    for r in rows:
        k = r["_slice"]
        yield pa.RecordBatch.from_pylist(
            [{"_slice": k, "before": [p.row() for p in before[k]], "after": [p.row() for p in after[k]]}], schema=CARRIED)


def _compared(table: pa.Table) -> pa.Table:
    """(host, sequence, shared) of the pages of a slice that share lines of their main text."""
    # the one row without a page has what the other slices know
    carry = [r for r in table.filter(pc.is_null(table["row"])).to_pylist()]
    rows = _in_order(table.filter(pc.is_valid(table["row"])))
    pages = [(r["host"], _Page(r)) for r in rows]
    before, after = ([_Page(p) for r in carry for p in r[side]] for side in ("before", "after"))
    prev, next_ = _before(pages, before), _before(pages[::-1], after)[-2::-1]
    found = [
        {"host": r["host"], "sequence": r["sequence"], "shared": _shared(page, [*p, *n])}
        for r, (_, page), p, n in zip(rows, pages, prev, next_)]
    return pa.Table.from_pylist([r for r in found if r["shared"]], schema=SHARED)


def shared_places(rows: DataFrame) -> DataFrame:
    """(host, sequence, shared): places of the lines that pages share with the nearest different page of their host.

    Pages of one host with equal lines are compared once, at the place of the first of them. ``rows`` come from :func:`line_hashes`.
    """
    first = F.min(F.struct("path", "row", "hashes", "sizes", "marks")).alias("first")
    pages = sliced(rows.groupBy("host", "sequence").agg(first).select("host", "sequence", "first.*"), ["host", "path", "row"])
    page = "array<struct<path: string, hashes: array<long>, sizes: array<int>, marks: array<byte>>>"
    thin = pages.select("_slice", "host", "path", "row", "hashes", "sizes", "marks")
    ends = thin.groupBy("_slice").applyInArrow(_ends, f"_slice int, first string, last string, heads {page}, tails {page}")
    carried = ends.repartition(1).mapInArrow(_carried, f"_slice int, before {page}, after {page}")
    both = pages.unionByName(carried, allowMissingColumns=True)
    return both.groupBy("_slice").applyInArrow(_compared, "host string, sequence long, shared array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    rows = pages_in_lines(pages)
    hashed = line_hashes(rows)
    # written, so that its size is known: where few pages lose lines, the texts of all pages stay where they are
    shared = stored(shared_places(hashed))
    joined = hashed.drop("hashes", "sizes").join(shared, ["host", "sequence"], "left").withColumn(
        "best", F.coalesce(F.array_max("marks"), F.lit(CHROME)).cast("int"))
    some = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.filter(some, lambda at: (F.col("best") > CHROME) & (F.get("marks", at) == F.col("best")))
    left = F.array_except(own, F.coalesce("shared", F.array().cast("array<int>")))
    return joined.select(
        "page_id", "url", F.array_join(F.transform(left, lambda at: F.get("lines", at)), "\n\n").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
