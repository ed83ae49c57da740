"""Main text of web pages by differencing with the page of the nearest URL.

Pages become lines (one for each block element).  Within a host, pages are ordered by URL path; a page is
paired with the neighbour in that order that shares the longer start of the path.  Lines that a longest
common subsequence finds in both are what the site puts on every page, and are deleted.  Every page is
differenced, over all of its lines.

Differencing alone is not right on its own: neighbours share sentences of their articles too, and adverts
differ from page to page.  So lines carry the zone they stand in, and marks overrule the differencing: lines
in an article or main element come back, lines in elements marked as menu, advert, footer, form or the like
go even if the neighbour lacks them.  The columns lines_deleted, lines_restored and lines_dropped say how many
lines each decided.  A neighbour that shares most of the text outside of templates is a copy, not a sibling, and
deletes nothing.

Neighbours are found on narrow keys in one global range sort, so a host with a third of all pages is
many tasks; a page is the partner of two others at most, so the joins have no hot key.  Differencing works on
line hashes; pages are parsed again at the end, and only their lines outside of templates are shuffled, once, to
meet the page's verdict.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.url_filter import host_of, path_of

MAIN, PLAIN, TEMPLATE = 0, 1, 2

SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button head title audio video datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
                   "tfoot th thead tr ul caption".split())
TEMPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
TRACKED = frozenset("nav footer aside form menu dialog header article main section div table ul ol p span blockquote figure details fieldset li td".split())
#: Words in class, id or role that mark an element as part of the page's template.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations sidebar sidebars "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus discussion reply replies "
    "respond login search skip pagination pager copyright legal disclaimer toolbar topbar contentinfo complementary hidden meta byline tags".split())
CONTENT = frozenset("article main content post entry story articlebody maincontent postcontent entrycontent".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


def _zone(tag: str, attrs: str, inside: int) -> int | None:
    """What an element makes of its content: MAIN, TEMPLATE, or None for no change; an article's own heading
    is no page header."""
    words: set[str] = set()
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return TEMPLATE
        if name in ("class", "id", "role"):
            words.update(re.split(r"[^a-z]+", value))
    words.discard("")
    if tag in ("article", "main"):
        return TEMPLATE if words and words <= MARKS else MAIN
    heading = {"header"} if inside == MAIN else set()
    if tag in TEMPLATE_TAGS - heading or words & MARKS - heading:
        return TEMPLATE
    if tag in ("div", "section") and words & CONTENT:
        return MAIN
    return None


def lines_of(page: str | None) -> list[tuple[str, int, bool]]:
    """Lines of a page in order: text, zone, and whether most of it is link text."""
    if not page:
        return []
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = link = 0
    stack: list[tuple[str, int]] = []  # open elements that were given a zone, and those in between
    zone = PLAIN

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, zone, 2 * linked > len(text)))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.strip())

    at, n, tag_re = 0, len(page), _TAG
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = tag_re.match(page, lt)
        if m is None and tag_re is _TAG:
            m = _LOOSE.match(page, lt)
            if m is not None:
                tag_re = _LOOSE  # an open quote somewhere: from here on a tag ends at the first bracket
        if m is None:
            if page.find(">", lt) < 0 and re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):
                break  # a tag that never ends
            add("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in SKIPPED and not closing and not attrs.endswith("/"):
            if tag in BLOCKS or tag in ("head", "title"):
                flush()
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif tag not in ("head", "button"):
                break
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            flush()
        if tag not in TRACKED or tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    zone = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main") and tag not in ("article", "main"):
                    break  # a stray end tag does not close the article
            continue
        if attrs.endswith("/"):
            continue
        new = _zone(tag, attrs, zone)
        if tag in ("p", "li", "td", "span") and new is None:
            continue
        flush()
        stack.append((tag, zone))
        if new == TEMPLATE:
            zone = TEMPLATE
        elif new == MAIN and (zone == PLAIN or zone == TEMPLATE and tag in ("article", "main") and not _within(stack, zone)):
            zone = MAIN
    flush()
    return out


def _within(stack: list[tuple[str, int]], zone: int) -> bool:
    """Whether an article that opens in a template zone belongs there: inside nav, aside or an article's own
    template parts it does; inside an unclosed box it does not."""
    return any(tag in ("nav", "footer", "aside", "form") or outer == MAIN for tag, outer in stack[:-1])


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, bit-parallel and in bounded memory."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = set(range(lo)) | set(range(len(a) - hi, len(a)))
    _middle(a, lo, len(a) - hi, b[lo:len(b) - hi], found)
    return found


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of ``a``, a bit set whose zeros count the common subsequence over prefixes of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _middle(a: list[int], begin: int, end: int, b: list[int], found: set[int], most: int = 200_000_000) -> None:
    if begin >= end or not b:
        return
    shared = set(b)
    if end - begin == 1 or not any(x in shared for x in a[begin:end]):
        if a[begin] in shared and end - begin == 1:
            found.add(begin)
        return
    if (end - begin) * len(b) <= most:
        rows = list(_rows(a[begin:end], b))
        j = len(b)
        for i in range(end - begin - 1, -1, -1):
            # does a[i] end a common subsequence of a[:i+1] and b[:j] that a[:i] does not reach?
            now, before = _zeros(rows[i], j), _zeros(rows[i - 1], j) if i else 0
            if now > before:
                found.add(begin + i)
                while j and _zeros(rows[i], j - 1) == now:
                    j -= 1
                j -= 1
        return
    half = (begin + end) // 2
    first = _counts(a[begin:half], b)
    second = _counts(a[half:end][::-1], b[::-1])
    j = max(range(len(b) + 1), key=lambda x: first[x] + second[len(b) - x])
    _middle(a, begin, half, b[:j], found, most)
    _middle(a, half, end, b[j:], found, most)


def _zeros(v: int, j: int) -> int:
    return j - (v & ((1 << j) - 1)).bit_count()


def _counts(a: list[int], b: list[int]) -> list[int]:
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (1 - (v >> j & 1)))
    return out


def menus(lines: list[tuple[str, int, bool]]) -> set[int]:
    """Places of three or more consecutive unmarked lines of link text: a menu without a mark."""
    found: set[int] = set()
    begin = None
    for i, (_, zone, linked) in enumerate([*lines, ("", MAIN, False)]):
        if zone == PLAIN and linked:
            begin = i if begin is None else begin
            continue
        if begin is not None and i - begin >= 3:
            found.update(range(begin, i))
        begin = None
    return found


def shared_lines(own: list[int], sizes: list[int], zones: list[int], partner: list[int]) -> set[int]:
    """Places of the lines that a page has in common with its partner, given the hashes of both; none for a copy."""
    shared = common(own, partner) if partner else set()
    size = sum(s for s, z in zip(sizes, zones) if z != TEMPLATE)
    in_both = sum(sizes[i] for i in shared if zones[i] != TEMPLATE)
    return set() if size and in_both > 0.7 * size else shared


def marked_lines(page: str | None) -> list[tuple[str, int]]:
    """Lines of a page in order: text and zone; unmarked menus count as template."""
    lines = lines_of(page)
    menu = menus(lines)
    return [(t, TEMPLATE if i in menu else z) for i, (t, z, _) in enumerate(lines)]


def split_shared(zones: list[int], shared: set[int]) -> tuple[list[int], int]:
    """Shared places counted among the lines outside of templates, and the number of shared template lines."""
    places: list[int] = []
    at = 0
    for i, zone in enumerate(zones):
        if zone != TEMPLATE:
            if i in shared:
                places.append(at)
            at += 1
    return places, len(shared) - len(places)


def keep(lines: list[str], zones: list[int], shared: set[int]) -> tuple[str, int]:
    """Main text of a page from its lines outside of templates and the places of those that differencing deletes; a
    content mark brings a line back.  Also the number of lines brought back."""
    kept = [t for i, (t, z) in enumerate(zip(lines, zones)) if z == MAIN or i not in shared]
    return "\n".join(kept), sum(zones[i] == MAIN for i in shared)


def _line_hashes(lines: list[str]) -> list[int]:
    import xxhash

    return [x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(t) for t in lines)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, lines_deleted, lines_restored, lines_dropped for every row of ``pages`` (page_id,
    url, html; more columns, also with names of the result, are ignored).

    Null or empty html gives an empty text; a page of any length is read whole.  Pages without a host have no partner,
    nor does the only page of a host.  Rows that repeat with the same page_id, url and html share one result and keep
    their number; ties in the URL order go by page_id, then by the digest of the row.  An empty table gives no rows.
    """
    kind = dict(pages.dtypes)["page_id"]
    digest = F.md5(F.concat_ws("\u0001", F.coalesce(F.col("page_id").cast("string"), F.lit("\u0002")),
                               F.coalesce("url", F.lit("\u0002")), F.coalesce(F.md5("html"), F.lit("\u0002"))))
    rows = pages.select("page_id", "url", "html", F.unhex(digest).alias("row"))

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "row", "own", "marks"]  # a mark is three times the line's length plus its zone
        for batch in it:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = [marked_lines(page.as_py()) for page in col["html"]]
            yield pa.RecordBatch.from_arrays(
                [col["page_id"], col["url"], col["row"], pa.array([_line_hashes([x[0] for x in f]) for f in found], pa.list_(pa.int64())),
                 pa.array([[3 * len(t) + z for t, z in f] for f in found], pa.list_(pa.int64()))], names=names)

    sketched = cut(rows.mapInArrow(sketch, f"page_id {kind}, url string, row binary, own array<long>, marks array<long>"))
    keys = sketched.select("row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''").distinct()
    each = sketched.select("row", "own", "marks").dropDuplicates(["row"])
    theirs = sketched.select(F.col("row").alias("partner"), F.col("own").alias("theirs")).dropDuplicates(["partner"])
    paired = each.join(neighbours(keys).join(theirs, "partner").select("row", "theirs"), "row")

    def difference(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = []
            for got in zip(col["own"], col["marks"], col["theirs"]):
                own, marks, partner = (x.as_py() for x in got)
                sizes, zones = [m // 3 for m in marks], [m % 3 for m in marks]
                found.append(split_shared(zones, shared_lines(own, sizes, zones, partner)))
            yield pa.RecordBatch.from_arrays([col["row"], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int64())],
                                             names=["row", "shared", "template_shared"])

    verdicts = paired.select("row", "own", "marks", "theirs").mapInArrow(difference, "row binary, shared array<int>, template_shared long")
    verdicts = verdicts.filter((F.size("shared") > 0) | (F.col("template_shared") > 0))

    def outside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "row", "lines", "zones", "templates"]
        for batch in it:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = [marked_lines(page.as_py()) for page in col["html"]]
            kept = [[x for x in f if x[1] != TEMPLATE] for f in found]
            yield pa.RecordBatch.from_arrays(
                [col["page_id"], col["url"], col["row"], pa.array([[t for t, _ in k] for k in kept], pa.list_(pa.string())),
                 pa.array([[z for _, z in k] for k in kept], pa.list_(pa.int8())),
                 pa.array([len(f) - len(k) for f, k in zip(found, kept)], pa.int64())], names=names)

    texts = rows.mapInArrow(outside, f"page_id {kind}, url string, row binary, lines array<string>, zones array<tinyint>, templates long")

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "lines_deleted", "lines_restored", "lines_dropped"]
        for batch in it:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            out = []
            for lines, zones, shared, templates, both in zip(*(col[c].to_pylist() for c in ("lines", "zones", "shared", "templates", "template_shared"))):
                text, restored = keep(lines, zones, set(shared or ()))
                out.append((text, len(shared or ()) - restored + (both or 0), restored, templates - (both or 0)))
            found = [pa.array([o[i] for o in out], pa.string() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([col["page_id"], col["url"], *found], names=names)

    met = texts.join(verdicts, "row", "left").drop("row")
    out = met.mapInArrow(assemble, f"page_id {kind}, url string, text string, lines_deleted long, lines_restored long, lines_dropped long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "lines_deleted", "lines_restored", "lines_dropped")


def neighbours(keys: DataFrame) -> DataFrame:
    """(row, partner) for rows (row, page_id, host, path): the neighbour in path order with the longer common start.

    One global range sort by (host, path, page_id, row).  Inside a range the neighbours are lag and lead;
    the first and last rows of ranges, two for each, complete them over range borders.
    """
    order = ["host", "path", "page_id", "row"]
    sorted_rows = cut(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order)
    it = F.struct("row", "host", "path")
    near = sorted_rows.withColumn("before", F.lag(it).over(inside)).withColumn("after", F.lead(it).over(inside))
    ends = sorted_rows.groupBy("range").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    across = Window.orderBy("range")  # one row for each range
    edges = ends.select("range", F.lag("last").over(across).alias("previous"), F.lead("first").over(across).alias("next"))
    near = near.join(edges, "range")

    def other(x: str):
        return F.struct(F.col(f"{x}.row").alias("row"), F.col(f"{x}.host").alias("host"), F.col(f"{x}.path").alias("path"))

    def alike(x):
        """How many leading path segments two pages share, then how close their paths' lengths are; null for
        another host."""
        steps = F.zip_with(F.split("path", "/"), F.split(x["path"], "/"), lambda a, b: a.eqNullSafe(b))
        start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"))
        shared = F.aggregate(steps, start, lambda acc, e: F.struct(
            (acc["open"] & e).alias("open"), (acc["n"] + (acc["open"] & e).cast("int")).alias("n")))["n"]
        closeness = -F.abs(F.length("path") - F.length(x["path"]))
        return F.when(x["host"] == F.col("host"), F.struct(shared.alias("segments"), closeness.alias("size")))

    before = F.coalesce("before", F.when(F.col("previous").isNotNull(), other("previous")))
    after = F.coalesce("after", F.when(F.col("next").isNotNull(), other("next")))
    near = near.select("row", "host", "path", before.alias("b"), after.alias("a"))
    scored = near.select("row", F.col("b.row").alias("b_row"), F.col("a.row").alias("a_row"), alike(F.col("b")).alias("sb"), alike(F.col("a")).alias("sa"))
    partner = F.when(F.col("sb").isNull(), F.when(F.col("sa").isNotNull(), F.col("a_row"))).when(F.col("sa").isNull(), F.col("b_row")).when(F.col("sb") >= F.col("sa"), F.col("b_row")).otherwise(F.col("a_row"))
    return scored.select("row", partner.alias("partner")).filter(F.col("partner").isNotNull())
