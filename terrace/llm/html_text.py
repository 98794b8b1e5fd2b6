"""Main text of pages by nearest-URL page differencing.

Pages of a host stand in order of their URL's path; a page is paired with the neighbour whose path begins like its
own for longest. The text lines (blocks) of the two are aligned by their longest common subsequence, and lines that
both have are deleted: they belong to the site, not to the page.

What the pairs of a host delete and leave is then read along the pages' structure. A block's spot is the chain of elements
that hold it (names and classes, digits aside, taken as mere labels). The host's text holder is the deepest element that
stands about once a page and holds at least ``HOLDS`` of the words that pages have for themselves; menus and footers that
vary from page to page lie outside it. A page with that element keeps what lies inside, but for spots inside whose lines
neighbours share at a rate of ``SITE`` or more: a line of the article's own that a neighbour carries too stays, a share bar
goes. Copies, which have under half of their words for themselves, are left out of this. So neither names of tags nor a teaser's <article> decide here.

Names of tags settle the rest: inside the holder, elements that say what they are (reader comments, adverts, forms) go; and
where pairs tell nothing (a page alone on its host, copies alone, no such element) the text is what <article>, in
or without <main>, or <main> holds, if that's at least half of the unmarked words, else all unmarked lines that no
neighbour shares. ``reasons`` counts what decided each line, with or without names of tags.

Blocks are separated by block-level tags, white space in a block, <br> included, is one space, and character
references are decoded. Pairing sorts line hashes by (host, path, page) in ranges; the pages at the ends of ranges
are paired in a second pass over four rows a range, so pairs don't depend on how rows were dealt out.

Defined cases: null html counts as empty; null or malformed url has host '' and path ''; null page_id comes first;
inline elements that are marked go without ending their block; repeated rows each give a row; empty tables give empty results; clashing extra columns are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_small, lean, written

#: Share of a host's own words that its text holder has, elements of it a page at most, and the rate from which a spot is the site's.
HOLDS, ONCE, SITE = 0.8, 1.5, 0.5

# Kinds of HTML elements, and words in class, id and role that mark what is not main text.
RAW = "script|style|noscript|template|iframe|svg|math|object|select|textarea|button|title|head"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer comment comments "
    "commentlist disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "pagination pager skip masthead toolbar search copyright".split()
)
#: Words that say no more than that an element holds something: "ad-slot" is an advert, "social-policy" isn't a share bar.
HOLDERS = frozenset(
    "area articles bar block box buttons column container content form group header icons inner item items label left links list module outer overlay panel posts region right row section "
    "slot stories strip top bottom unit wrap wrapper zone".split()
)
#: Classes that mark an <article> that is no page's text.
ASIDE = frozenset("comment comments reply teaser ad ads advert advertisement sponsored promo related".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# a quote is one only where a value begins; anywhere else in a tag it is a character like any other
ATTRIBUTES = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<[!?/][^>]*>",
    re.S | re.I,
)
LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z0-9]+")

OPEN, OWN, NOT = 0, 1, 2


def _names(token: str) -> bool:
    """Whether a class or id names a part that isn't main text: by its last word, or by its first with words that only hold."""
    words = [w for w in PART.findall(token) if not w.isdigit()]
    return bool(words) and (words[-1] in MARKS or words[0] in MARKS and all(w in HOLDERS or w in MARKS for w in words[1:]))


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element says that it is not main text."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main") and not inside:
        return False
    if tag == "article" and not inside:
        return any(ASIDE & set("".join(v).lower().split()) for name, *v in LABEL.findall(attributes) if name.lower() == "class")
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?false)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", attributes)):
        return True
    for name, *values in LABEL.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if set(PART.findall(value)) & ROLES:
                return True
        elif any(_names(token) for token in value.split()):
            return True
    return False


def _label(tag: str, attributes: str) -> str:
    """An element's name in a spot: its tag and classes, with digits alike."""
    for name, *values in LABEL.findall(attributes or ""):
        if name.lower() == "class":
            return ".".join([tag, *re.sub(r"\d+", "0", "".join(values).lower().replace("/", "")).split()])
    return tag


def blocks(html: str | None) -> tuple[list[tuple[str, int, str]], dict[str, int]]:
    """(text, state, spot) of each block, and how many elements with text each spot and beginning of a spot has.

    A state is NOT in a marked element, OWN in what the tags call the page's text, else OPEN.
    """
    html = html or ""
    out: list[tuple[str, bool, bool, bool, str]] = []  # text, marked, in article, in main, spot
    stack: list[list] = []  # open elements: tag, what held before them (articles, mains, marked, skipped), spot, seen
    seen: dict[str, int] = {}
    held: list[str] = []
    articles = mains = marked = skipped = at = 0

    def close():
        if held:
            text = " ".join(html_module.unescape("".join(held)).split())
            held.clear()
            if text:
                for e in stack:
                    if e[5] is not None and not e[6]:
                        e[6] = True
                        seen[e[5]] = seen.get(e[5], 0) + 1
                out.append((text, marked > 0, articles > 0, mains > 0, next((e[5] for e in reversed(stack) if e[5] is not None), "")))

    for m in TOKEN.finditer(html):
        if m.start() > at and not skipped:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not skipped:
                held.append(html_module.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "br" and not skipped:
            held.append(" ")
        if tag in VOID and tag != "hr":
            continue
        inside = articles + mains > 0
        inline = tag not in BLOCKS
        if inline and not (m[2] and any(e[0] == tag for e in stack)) and (m[2] or not _marked(tag, m[4], inside)):
            continue
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and not m[2] and stack and stack[-1][0] == tag:
            close()
            _, articles, mains, marked, skipped, *_ = stack.pop()
        if not inline:
            close()
        if m[2]:
            if any(e[0] == tag for e in stack):
                while True:
                    name, articles, mains, marked, skipped, spot, _ = stack.pop()
                    if spot is not None and inline:  # the inline element held blocks
                        close()
                    if name == tag:
                        break
        elif tag != "hr" and not m[4].rstrip().endswith("/"):
            above = next((e[5] for e in reversed(stack) if e[5] is not None), "")
            stack.append([tag, articles, mains, marked, skipped, None if inline else f"{above}/{_label(tag, m[4])}", False])
            if inline:
                skipped += 1
                continue
            marked += _marked(tag, m[4], inside)
            articles += tag == "article" and not marked
            mains += tag == "main"
    if at < len(html) and not skipped:
        held.append(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", html[at:]))
    close()
    words = [len(line[0].split()) for line in out]
    total = lambda keep: sum(n for n, line in zip(words, out, strict=True) if not line[1] and keep(line))
    free, in_main = total(lambda line: True), total(lambda line: line[3])
    own = lambda line: False
    if in_main:
        own = (lambda line: line[2] and line[3]) if 2 * total(lambda line: line[2] and line[3]) >= in_main else (lambda line: line[3])
    elif 2 * total(lambda line: line[2]) >= free:
        own = lambda line: line[2]
    return [(line[0], NOT if line[1] else OWN if own(line) else OPEN, line[4]) for line in out], seen


def lines(html: str | None) -> list[tuple[str, int]]:
    """(text, state) of each block."""
    return [(text, state) for text, state, _ in blocks(html)[0]]


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with each beginning of ``y``."""
    last = np.zeros(len(y) + 1, np.int32)
    for v in x:
        last[1:] = np.maximum(last[1:], np.where(y == v, last[:-1] + 1, 0))
        np.maximum.accumulate(last, out=last)
    return last


def _matched(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of ``x`` in a longest common subsequence with ``y``, in memory of one row: halves of ``x`` with their share of ``y``."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if b - a == 1:
            if (y[c:d] == x[a]).any():
                out.append(a)
            continue
        mid = (a + b) // 2
        cut = c + int(np.argmax(_lengths(x[a:mid], y[c:d]) + _lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return out


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which of ``a`` are in a longest common subsequence with ``b``; equal ends are matched first."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [True] * lo + [False] * (len(a) - lo - hi) + [True] * hi
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    # lines that only one side has cannot be in it
    both = set(x) & set(y)
    places = [i for i, v in enumerate(x) if v in both]
    for k in _matched(np.array([x[i] for i in places], np.int64), np.array([v for v in y if v in both], np.int64)):
        out[lo + places[k]] = True
    return out


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _decide(before: dict | None, page: dict, after: dict | None) -> list[int] | None:
    """Places of the lines that the nearest page has too; None where the page is alone on its host."""
    near = [p for p in (before, after) if p is not None and p["host"] == page["host"]]
    if not near:
        return None
    other = max(near, key=lambda p: _common(p["path"], page["path"]))
    return [i for i, hit in enumerate(shared(page["hashes"], other["hashes"])) if hit]


KEYS = "tag long, host string, path string"
ROW = f"{KEYS}, hashes array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        host, path, texts, hashes, state, spots, sizes, holders, counts = ([] for _ in range(9))
        for url, html in zip(batch.column("url"), batch.column("html"), strict=True):
            try:
                parts = urlsplit(url.as_py() or "")
                host.append((parts.netloc or "").lower())
                path.append(parts.path or "")
            except ValueError:
                host.append("")
                path.append("")
            got, seen = blocks(html.as_py())
            texts.append([t for t, _, _ in got])
            hashes.append(np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _, _ in got], np.uint64).view(np.int64))
            state.append([s for _, s, _ in got])
            spots.append([s for _, _, s in got])
            sizes.append([len(t.split(" ")) for t, _, _ in got])
            holders.append(list(seen))
            counts.append(list(seen.values()))
        strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url", "tag")), pa.array(host), pa.array(path), pa.array(texts, strings), pa.array(hashes, pa.list_(pa.int64())), pa.array(state, ints), pa.array(spots, strings), pa.array(sizes, ints), pa.array(holders, strings), pa.array(counts, ints)],
            ["page_id", "url", "tag", "host", "path", "texts", "hashes", "state", "spots", "sizes", "holders", "counts"],
        )


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions for the rows inside a sorted range; its first and last two rows go on to the second pass."""
    part, place = TaskContext.get().partitionId(), 0
    window: list[dict] = []
    names = ["tag", "host", "path", "hashes"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def out(rows):
        """rows: (row, place or None, gone or None)."""
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[n] if at is not None or n == "tag" else None for r, at, _ in rows], k) for n, k in zip(names, kinds, strict=True)), pa.array([part] * len(rows), pa.int32()), pa.array([at for _, at, _ in rows], pa.int64()), pa.array([g for _, _, g in rows], pa.list_(pa.int32()))],
            [*names, "part", "place", "gone"],
        )

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if place < 2:
                rows.append((row, place, None))
            window.append(row)
            if len(window) == 3:
                if (gone := _decide(*window)) is not None:
                    rows.append((window[1], None, gone))
                window.pop(0)
            place += 1
        if rows:
            yield out(rows)
    if tail := [(r, place - len(window) + k, None) for k, r in enumerate(window) if place - len(window) + k >= 2]:
        yield out(tail)


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions for the first and last rows of ranges, given the ends of all ranges in order."""
    window: list[dict | None] = [None]
    tags, gone = [], []

    def settle(last, page, following):
        inside = page["place"] > 0 and following is not None and following["part"] == page["part"]
        if not inside and (got := _decide(last, page, following)) is not None:
            tags.append(page["tag"])
            gone.append(got)

    for batch in batches:
        for row in batch.to_pylist():
            window.append(row)
            if len(window) == 3:
                settle(*window)
                window.pop(0)
    if window[-1] is not None:
        settle(*window[-2:], None)
    yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["tag", "gone"])


def differenced(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, texts, state, spots, sizes, holders, counts, gone) for each row: its lines, what the markup says of each,
    where each stands, its words, and the places of those that the nearest page has too (null where there is none)."""
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.xxhash64(pages[id_col], pages[url_col], pages[html_col]).alias("tag"))
    schema = "page_id long, url string, tag long, host string, path string, texts array<string>, hashes array<long>, state array<int>, spots array<string>, sizes array<int>, holders array<string>, counts array<int>"
    parsed = written(rows.mapInArrow(lean(_parse), schema), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page_id", "tag"]
    dealt = parsed.select(*order, "hashes").repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    found = written(dealt.select("tag", "host", "path", "hashes").mapInArrow(lean(_pair), f"{ROW}, part int, place long, gone array<int>"), "pairs")
    ends = found.where("gone is null").select("tag", "host", "path", "hashes", "part", "place")
    ends = ends.repartition(1).sortWithinPartitions("part", "place").mapInArrow(lean(_join_ends), "tag long, gone array<int>")
    gone = written(found.where("gone is not null").select("tag", "gone").union(ends).dropDuplicates(["tag"]), "gone")
    discard(found)
    few = is_small(gone, 100_000) and gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= 2_000_000
    gone = F.broadcast(gone) if few else gone
    return parsed.drop("path", "hashes").join(gone, "tag", "left").drop("tag")


def structures(rows: DataFrame) -> DataFrame:
    """(host, holder, site) from ``differenced``: the host's text holder, if pairs show one, and hashes of spots whose lines are
    the site's. A row for each host with pairs that aren't copies; what it holds follows the number of different structures of its pages."""
    paired = rows.where("gone IS NOT NULL").select("host", "spots", "sizes", "holders", "counts", "gone")
    # a page that has under half of its words for itself is a copy, and tells nothing of the site
    words = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    paired = paired.where(2 * words(F.filter("sizes", lambda _, i: ~F.array_contains("gone", i))) >= words("sizes"))
    line = F.posexplode(F.arrays_zip(F.col("spots").alias("spot"), F.col("sizes").alias("size"))).alias("at", "line")
    each = paired.select("host", "gone", line).select("host", "line.spot", "line.size", F.array_contains("gone", F.col("at")).alias("shared"))
    spots = each.groupBy("host", "spot").agg(F.count("*").alias("lines"), F.count_if("shared").alias("shared"), F.sum(F.when(~F.col("shared"), F.col("size")).otherwise(0)).alias("own"))
    # words below each element: those of all spots that begin with it
    names = F.split("spot", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    under = spots.select("host", F.explode(above).alias("holder"), "own").groupBy("host", "holder").agg(F.sum("own").alias("own"))
    held = F.explode(F.arrays_zip(F.col("holders").alias("holder"), F.col("counts").alias("n"))).alias("e")
    often = paired.select("host", held).groupBy("host", "e.holder").agg(F.sum("e.n").alias("elements"), F.count("*").alias("on"))
    total = spots.groupBy("host").agg(F.sum("own").alias("total"), F.array_sort(F.collect_set(F.when(F.col("shared") >= SITE * F.col("lines"), F.xxhash64("spot")))).alias("site"))
    good = under.join(often, ["host", "holder"]).join(total.select("host", "total"), "host").where((F.col("total") > 0) & (F.col("own") >= HOLDS * F.col("total")) & (F.col("elements") <= ONCE * F.col("on")))
    # html and body hold all of a page and tell nothing
    last = F.element_at(F.split("holder", "/"), -1)
    good = good.where(~F.substring_index(last, ".", 1).isin("html", "body", "")).groupBy("host").agg(F.max_by("holder", F.struct(F.size(F.split("holder", "/")), "own", "holder")).alias("holder"))
    return total.select("host", "site").join(good, "host", "left")


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tags: bool = True) -> DataFrame:
    """(page_id, url, texts, why): for each line ``text`` if it stays, else what deletes it. Without ``tags``, names of tags say nothing."""
    rows = differenced(pages, id_col, url_col, html_col)
    if not tags:
        rows = rows.withColumn("state", F.transform("state", lambda s: F.lit(OPEN)))
    hosts = written(structures(rows), "structures")
    rows = rows.join(F.broadcast(hosts) if is_small(hosts, 20_000) else hosts, "host", "left")
    within = lambda spot: (spot == F.col("holder")) | F.startswith(spot, F.concat("holder", F.lit("/")))
    rows = rows.withColumn("told", F.coalesce(F.exists("spots", within), F.lit(False)))
    rows = rows.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    line = F.arrays_zip(F.col("state").alias("state"), F.col("spots").alias("spot"))
    by_pairs = F.transform(line, lambda x, i: F.when(~within(x["spot"]), "elsewhere").when(F.array_contains("site", F.xxhash64(x["spot"])), "shared").when(x["state"] == NOT, "marked").otherwise("text"))
    own = F.array_contains("state", OWN)
    # of a page all of whose open lines a neighbour has, none goes as shared: it's a copy
    copied = ~own & F.forall(line, lambda x: x["state"] == NOT) | ~own & (F.size(F.filter(line, lambda x, i: (x["state"] == OPEN) & ~F.array_contains("gone", i))) == 0)
    by_tags = F.transform(line, lambda x, i: F.when(x["state"] == NOT, "marked").when(own & (x["state"] == OPEN), "outside").when((x["state"] == OPEN) & F.array_contains("gone", i) & ~copied, "shared").otherwise("text"))
    return rows.select("page_id", "url", "texts", F.when(F.col("told"), by_pairs).otherwise(by_tags).alias("why"), "told")


def reasons(pages: DataFrame, tags: bool = True) -> DataFrame:
    """(reason, lines): how many lines stay and what deleted the others; ``elsewhere`` and ``shared`` come from pairs of pages."""
    return decided(pages, tags=tags).select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count("*").alias("lines"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tags: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    rows = decided(pages, id_col, url_col, html_col, tags)
    left = F.filter(F.arrays_zip(F.col("texts").alias("text"), F.col("why").alias("why")), lambda x: x["why"] == "text")
    text = F.array_join(F.transform(left, lambda x: x["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
