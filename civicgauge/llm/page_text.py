"""Operator 4: main text of web pages, by markup and by differencing with the page of the nearest URL.

A page is read into blocks of text, each with the zone its elements put it in: dropped (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, comments; by a class or id, on any block element, only if the whole name says so
and no article is inside; a form only if nothing that pages have is inside), main (inside an article or main element), or open. Pages are ordered by
host, path and content, and each is paired with the neighbour on its host whose path shares more with its own, the earlier
one of equals. The lines of the two are aligned by their longest common subsequence, and shared lines are template: they are
deleted. A neighbour that has all of a page's lines is a copy of it and tells nothing of templates; then the next of two
neighbours on either side serves. Inside an article a shared line can be a quotation, or the article a copy: there it is
template if two of these four neighbours share it, and if of the article text of these three pages no two have more than
half in common. The text of a page is what is left of its article and open blocks. Pages of a host with the same lines count
as one, the first of them, and all get its result.

Neighbours come from a range partitioning by host and path, so a host with a third of all pages spans many tasks, and the
first and last two pages of each range are handed over to the ranges beside it: the pairs do not depend on where ranges end. What
moves is a hash for each line, not the pages.

Defined results: a null or empty html gives an empty text; a page without a host in its URL, and one alone on its host, is
paired with none; equal rows (same id, URL and html) count as one page and give equal texts; pages of any length are read whole;
an empty table gives an empty table; other columns are not read. White space is what Unicode calls so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgauge.llm.tasks import map_rows
from civicgauge.session import durable

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of the markup language: elements with unparsed text, elements that hold others, elements that break a line.
UNPARSED = frozenset("script style title textarea iframe noembed noframes xmp".split())
HOLDERS = frozenset("html body article main section div nav header footer aside form menu dialog select button svg canvas object video audio template "
                    "noscript table ul ol dl figure fieldset details blockquote center".split())
BREAKING = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li tr dt dd hr pre figcaption caption address summary hgroup legend thead tbody tfoot".split())
SPACING = frozenset("br td th".split())
DROPPED = frozenset("nav footer aside menu dialog select button svg canvas object video audio template noscript fieldset".split())
MAIN = frozenset("article main".split())
#: A form with one of these inside is laid around a page, and no form of it.
OF_PAGES = frozenset("article main nav header footer h1".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu sidebar breadcrumb breadcrumbs footer comment "
    "comments discussion disqus respond reply cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay share "
    "sharing social related recommended login signup search toolbar pagination pager masthead".split())
# What the other parts of a compound name may be, as in share-buttons or site-footer; has-sidebar or related-work are no such names.
NAME_PARTS = frozenset(
    "area bar block body bottom box button buttons container content form global group header icons inner item items left link links list main outer page "
    "panel post primary reader right row secondary section site slot top unit user widget wrap wrapper zone".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())


def _dropped_name(name: str) -> bool:
    """Whether a class or id is a dropped name, alone or with parts that only say where or what box it is."""
    parts = [p for p in re.split("[_-]+", name) if p]
    named = [p for p in parts if p in DROPPED_NAMES]
    return bool(named) and all(p in DROPPED_NAMES or p in NAME_PARTS or p.isdigit() for p in parts)


def _dropped(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is dropped: for what it is, for a name it has."""
    if tag in DROPPED or tag == "header" and not in_main:
        return True, False
    if tag in ("html", "body") or not attributes or attributes.isspace():
        return False, tag == "form"
    named = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name in ("class", "id") and any(map(_dropped_name, value.split())):
            named = True
        if name == "role" and value.strip() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, named and (in_main or tag != "main") or tag == "form"


def blocks(html: str) -> list[tuple[bool, str]]:
    """Blocks of text outside dropped elements, in page order: whether inside an article, and the text."""
    found: list[tuple[bool, str]] = []
    held: list[str] = []
    open_holders: list[tuple[str, bool, bool]] = []  # tag, and what was so before it: dropped, main
    open_tags: Counter[str] = Counter()
    muted = ""  # the paragraph or the like that is dropped for a name and still open
    named: list[tuple[int, int, str]] = []  # elements dropped for a name, and forms: depth, first block, tag; one that holds an article is not dropped
    dropped = main = False
    at, n = 0, len(html)

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                found.append((main, text))
            held.clear()

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        if (text := m.group("text")) is not None:
            if not dropped and not muted:
                held.append(unescape(text) if "&" in text else text)
            continue
        tag = m.group("tag") or m.group("tag2")
        if tag is None:
            continue
        tag, ends = tag.lower(), m.group("end") or m.group("end2")
        if tag in UNPARSED:
            if not ends:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else n
            continue
        if tag in SPACING:
            held.append(" ")
        elif tag in BREAKING:
            flush()
            muted = ""
            if tag not in HOLDERS and not ends and not dropped:
                muted = tag if any(_dropped(tag, m.group("attributes") or "", main)) else ""
        if tag in OF_PAGES and not ends and not dropped:
            named = [x for x in named if x[2] != "form"]
        if tag in HOLDERS:
            if not ends:
                if (m.group("attributes") or "").rstrip().endswith("/") and tag == "svg":
                    continue
                open_holders.append((tag, dropped, main))
                open_tags[tag] += 1
                is_dropped, has_name = (True, False) if dropped else _dropped(tag, m.group("attributes") or "", main)
                dropped = is_dropped
                if has_name:
                    named.append((len(open_holders), len(found), tag))
                if tag in MAIN and not (main or dropped or has_name):
                    named.clear()
                    main = True
            elif open_tags[tag]:
                while True:
                    if named and named[-1][0] == len(open_holders):
                        del found[named.pop()[1]:]
                    name, dropped, main = open_holders.pop()
                    open_tags[name] -= 1
                    if name == tag:
                        break
    flush()
    return found[:named[0][1]] if named else found


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, on whole rows of bits at a time."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    middle_a, middle_b = a[start:len(a) - stop], b[start:len(b) - stop]
    inside = set(middle_b)
    rows = [(i, x) for i, x in enumerate(middle_a, start) if x in inside]
    also = {x for _, x in rows}
    columns = [x for x in middle_b if x in also]
    found = [i for i, _ in _aligned(rows, columns)]
    return [*range(start), *found, *range(len(a) - stop, len(a))]


#: Bits of states that are held at a time to align two lists; longer lists are halved first.
HELD_BITS = 1 << 26
Row = tuple[int, int]


def _states(lines: Iterable[int], columns: list[int]) -> Iterator[int]:
    """After each line, a bit for each column: zero where the longest common subsequence grows by it."""
    places: dict[int, int] = {}
    for j, x in enumerate(columns):
        places[x] = places.get(x, 0) | 1 << j
    full = state = (1 << len(columns)) - 1
    yield state
    for x in lines:
        hit = state & places.get(x, 0)
        state = (state + hit | state - hit) & full
        yield state


def _lengths(lines: Iterable[int], columns: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of all lines with the first 0, 1, ... columns."""
    for state in _states(lines, columns):  # noqa: B007  (the last one counts)
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(columns) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:len(columns)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(rows: list[Row], columns: list[int]) -> list[Row]:
    """Rows of a longest common subsequence with ``columns``, in space that does not grow with their product."""
    if not rows or not columns:
        return []
    if len(rows) > 1 and len(rows) * len(columns) > HELD_BITS:
        half = len(rows) // 2
        before = _lengths((x for _, x in rows[:half]), columns)
        after = _lengths((x for _, x in reversed(rows[half:])), columns[::-1])[::-1]
        cut = int(np.argmax(before + after))
        return _aligned(rows[:half], columns[:cut]) + _aligned(rows[half:], columns[cut:])
    states = list(_states((x for _, x in rows), columns))
    found, i, j = [], len(rows), len(columns)
    while i and j:
        if states[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if states[i] >> (j - 1) & 1:
                found.append(rows[i])
                j -= 1
    return found[::-1]


def shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


Page = tuple[str, list[int], list[int]]  # path, lines, and the characters of each line inside an article (0 outside)


def main_size(sizes: list[int], at: list[int] | None = None) -> int:
    return sum(sizes if at is None else (sizes[i] for i in at))


def differ(a: Page, b: Page, shared: list[int]) -> bool:
    """Whether at most half of the article text of either page is in ``shared``, positions in ``a``: no copy, no new version."""
    return 2 * main_size(a[2], shared) <= min(main_size(a[2]), main_size(b[2]))


def template_lines(own: Page, neighbours: list[Page | None]) -> list[int]:
    """Positions of template lines.

    Outside articles: the lines shared with the nearest neighbour that is not a copy. Inside: those shared with two
    neighbours, where the articles of all three differ.
    """
    lines, sizes = own[1:]
    near = sorted((n for n in neighbours if n), key=lambda n: -shared_path(own[0], n[0]))
    shared = [(n, x) for n in near if len(x := common_lines(lines, n[1])) < len(lines)]
    deleted = {i for i in shared[0][1] if not sizes[i]} if shared else set()
    seen: list[Page] = []
    times: dict[int, int] = {}
    for other, at in shared if any(sizes) else ():
        inside = [i for i in at if sizes[i]]
        if inside and differ(own, other, at) and all(differ(other, x, common_lines(other[1], x[1])) for x in seen):
            seen.append(other)
            for i in inside:
                times[i] = times.get(i, 0) + 1
    return sorted(deleted | {i for i, n in times.items() if n > 1})


def _page_key(page_id: str, url: str, html: str) -> Column:
    return F.xxhash64(page_id, url, html)


def template_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key`` of each page with template lines, and ``deleted``: the positions of these lines among its blocks."""
    address = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    rows = pages.select(_page_key(page_id, url, html).alias("key"), F.lower(address).alias("host"), path.alias("path"), F.col(html).alias("html"))

    def make():
        def run(keys, hosts, paths, texts):
            read = [blocks(x) for x in texts]
            lines = [[xxhash.xxh64_intdigest(t.encode()) - 2 ** 63 for _, t in x] for x in read]
            return [keys, hosts, paths, [np.array(x, dtype=np.int64) for x in lines], [[len(t) if main else 0 for main, t in x] for x in read]]

        return run

    lines = map_rows(rows.filter((F.col("host") != "") & (F.length("html") > 0)), ["key", "host", "path", "html"],
                     "key long, host string, path string, lines array<long>, sizes array<int>", make)
    # Copies: pages of a host with the same lines are one page, the first of them, whose result all of them get.
    lines = durable(lines.withColumn("content", F.xxhash64("lines", "sizes")), "page-lines")
    firsts = lines.groupBy("host", "content").agg(F.min(F.struct("path", "key", "lines", "sizes")).alias("first")).select("host", "content", "first.*")
    # Ranges of neighbours.
    ranged = durable(firsts.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id()), "page-ranges")
    page, place = F.struct("host", "path", "lines", "sizes"), ["host", "path", "key"]
    steps = {"before0": F.lag(page), "after0": F.lead(page), "before1": F.lag(page, 2), "after1": F.lead(page, 2)}
    order, beside = Window.partitionBy("part").orderBy(*place), Window.orderBy(*place)
    seen = ranged.select("part", "content", *place, "lines", "sizes", *(x.over(order).alias(name) for name, x in steps.items()))
    # The first and last two pages of each range find among themselves what their own range lacks.
    ends = seen.filter(F.col("before1").isNull() | F.col("after1").isNull()).select(*place, "lines", "sizes")
    ends = durable(ends.select(F.col("key").alias("end_key"), *(x.over(beside).alias(f"beside_{name}") for name, x in steps.items())), "page-ends")
    seen = seen.join(ends, F.col("key") == F.col("end_key"), "left")
    found = {name: F.coalesce(name, f"beside_{name}") for name in steps}
    pairs = seen.select("key", "host", "content", "path", "lines", "sizes", *(
        F.when(x["host"] == F.col("host"), x[f]).alias(f"{f}_{name}") for name, x in found.items() for f in ("path", "lines", "sizes")))

    def align():
        def run(keys, hosts, contents, paths, lines, sizes, *others):
            columns = [zip(*others[i:i + 3]) for i in range(0, len(others), 3)]
            return [hosts, contents, [template_lines(own, [n if n[1] is not None else None for n in near]) for own, *near in zip(zip(paths, lines, sizes), *columns)]]

        return run

    found = map_rows(pairs, pairs.columns, "host string, content long, deleted array<int>", align).filter(F.size("deleted") > 0)
    return lines.select("key", "host", "content").dropDuplicates(["key"]).join(found, ["host", "content"]).select("key", "deleted")


def main_text(found: list[tuple[bool, str]], deleted: set[int]) -> str:
    """The blocks that are not template. Next to an article, an open block that repeats one of its blocks adds nothing."""
    inside = {text for main, text in found if main}
    return "\n\n".join(text for i, (main, text) in enumerate(found) if i not in deleted and (main or text not in inside))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Page id, URL, ``text`` and ``n_chars`` of each row."""
    template = durable(template_of(pages, page_id, url, html), "page-template").withColumnRenamed("key", "template_key")
    rows = pages.select(F.col(page_id), F.col(url), F.coalesce(F.col(html), F.lit("")).alias("html"), _page_key(page_id, url, html).alias("key"))
    rows = rows.join(template, F.col("key") == F.col("template_key"), "left")

    def make():
        def run(keys, urls, texts, deleted):
            out = [main_text(blocks(t), set(d or ())) for t, d in zip(texts, deleted)]
            return [keys, urls, out, list(map(len, out))]

        return run

    kinds = dict(pages.dtypes)
    return map_rows(rows, [page_id, url, "html", "deleted"], f"`{page_id}` {kinds[page_id]}, `{url}` string, text string, n_chars long", make)
