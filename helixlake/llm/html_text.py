"""Main text of web pages: differences from the page of the nearest URL, ranked by what containers say.

A page is cut into blocks, the lines of its text.  Pages are sorted by host and URL path; a page's neighbours are the nearest one before and
the nearest one behind of the same host whose html is another, and the one with the longer common path comes first.  The blocks of both pages
are aligned by a longest common subsequence, and those that both have are template and deleted.  A neighbour that has half of a page's
article or more (`COPY`) is a copy of it, whose shared blocks tell nothing of what is template; then the other neighbour decides, and where that is one too, nothing
is deleted.  Paragraphs, headings, entries and quotations of an element that is marked as the article are likely the author's, and articles of one host share whole
sentences: where a neighbour that is no copy has them too they are in doubt, and the host settles that.  The pages with a line in their article are counted in each host, equal pages once,
and lines of most of the host's pages are notices, which go where they are in doubt; all others stay, and so do headings and tables' labels, which articles may have in common.  Of what is left, blocks stay by what their containers say: menus, headers, footers, sidebars, notices, adverts, forms and comments
go, as they may differ from page to page; on pages that mark an article or main element, so does all outside of it.  Names of
content (as in `class="post"`) count only where no neighbour tells anything.

Pages are dealt out to ranges of (host, path, id), so that a large host is spread over tasks and none is gathered in one.  Each range also gets the
pages of other ranges that are neighbours of its first and last ones, so that the result doesn't depend on the ranges.

Cases: a null or empty page has an empty text; a null URL is a host and path of empty names; repeated rows are rows of their own (a copy is no
neighbour, and counts once); hosts of few pages have no notices; an element without an end ends with the element around it, a head with the first block, and inline ones such as buttons and frames
with the next block; empty tables give empty results; other columns of the input are not touched.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import FEW_ROWS, table, written
from .words import chunks

#: LABEL: a heading or a table's label of an article; PART: in an article, but in no paragraph, heading, entry or quotation of it.
LABEL, ARTICLE, PART, LIKELY, UNKNOWN, OTHER = 4, 3, 2, 1, 0, -1
#: Cells of a table of common subsequences that is held as a whole; larger ones are divided.
CELLS = 1 << 26
#: Share of a page's characters from which a neighbour that has them is a copy: of those in its article, or, where none is marked, of all, as template may
#: be most of a page then; the second share holds if both neighbours have the first.
COPY, COPY_OF_ALL = (0.5,), (0.9, 1.0)
#: Lines of marked articles that so many pages of a host have, and more than this share of its different pages, are notices.
NOTICE_PAGES, NOTICE = 5, 0.5
#: Ranges for each of Spark's shuffle partitions, which evens out how many a partition gets.
RANGES = 4
#: Keys for each range that are drawn to place the ranges' borders, by least hash: they balance tasks, and don't change results.
BORDER_SAMPLE = 32

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What stands in these is no text of the page; those of the first line can't hold blocks, and a block ends them.
INLINE_HIDDEN = frozenset("button select textarea iframe svg object head".split())
HIDDEN = INLINE_HIDDEN | frozenset("noscript template".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog head title".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LABELS = HEADINGS | frozenset("dt td th caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Words of class and id names that mark what is no article.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies dialog disqus footer form gdpr "
    "header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promos promotion related replies reply respond search share sharing "
    "sidebar signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tagcloud teaser toolbar topbar widget widgets".split()
)
#: Those that name sections of articles as well, as in `related-work`: there they count alone, or beside other names and these of lists and boxes.
ORDINARY = frozenset("alert alerts form menu menus notice notices promotion related reply respond search share sharing social sponsor".split())
BOXES = frozenset("area articles bar block box button buttons container content field group icon icons inner input items links list main module news outer pages panel posts section stories story topics wrap wrapper".split())
#: Words of class and id names that mark what is likely the article, where no element says so.
LIKELY_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
#: A layout's name for what it has or lacks is none of a part.
LAYOUT = re.compile(r"\b(?:has|with|without|no)[-_][a-z]+")
WORD = re.compile(r"[a-z]+")


def _names_other(names: set[str], within: int) -> bool:
    """Whether the words of one class or id name mark what is no article."""
    if within != ARTICLE:
        return not NAMES.isdisjoint(names)
    found = names & NAMES - {"header"}
    return bool(found - ORDINARY) or bool(found) and names <= NAMES | BOXES


def _says(tag: str, attributes: str, within: int) -> int:
    """What an element says of its content; within: what holds around it."""
    if tag in NO_ARTICLE:
        return OTHER
    likely = False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                if tag in ("html", "body", "main", "article"):
                    continue
                for one in "".join(values).split():
                    names = set(WORD.findall(LAYOUT.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())))
                    if _names_other(names, within):
                        return OTHER
                    likely = likely or not LIKELY_NAMES.isdisjoint(names)
            elif name == "role":
                if value in ROLES:
                    return OTHER
                if value in ("main", "article"):
                    return ARTICLE
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return OTHER
            elif name == "itemprop" and value == "articlebody":
                return ARTICLE
    return ARTICLE if tag in ("article", "main") else LIKELY if likely else UNKNOWN


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, what containers say) of each block of a page that has a text."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements, and what holds in them
    parts: list[str] = []
    here, hidden, prose = UNKNOWN, 0, PART  # hidden: open elements up to the outermost hidden one, or none; prose: what a block in an article is

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, prose if here == ARTICLE else here))

    def close(k: int) -> None:
        nonlocal here, hidden
        del stack[k:]
        here = stack[-1][1] if stack else UNKNOWN
        hidden = hidden if hidden <= k else 0

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" and not hidden:
            parts.append(" ")
        if tag in BLOCKS:
            if not m[2] and tag not in ("title", "head", "html"):
                while hidden and stack[hidden - 1][0] in INLINE_HIDDEN:
                    close(hidden - 1)
            if not hidden:
                flush()
                prose = PART if m[2] or tag not in PROSE else LABEL if tag in LABELS else ARTICLE
        if tag in VOID or m[4].endswith("/"):
            continue
        if m[2]:
            if hidden and tag in ("p", "li"):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in HIDDEN and (not hidden or k < hidden - 1):
                        flush()
                    close(k)
                    break
            continue
        if tag in HIDDEN:
            if not (stack and stack[-1][0] == tag):
                stack.append((tag, here))
                hidden = hidden or len(stack)
            continue
        if hidden:
            if tag in BLOCKS and tag not in HEADINGS and tag not in ("p", "li"):
                stack.append((tag, here))
            continue
        if tag == "p" or tag == "li":
            # the next paragraph or entry ends one that wasn't closed
            if stack and stack[-1][0] == tag:
                close(len(stack) - 1)
        says = _says(tag, m[4], here)
        if tag == "header":
            says = OTHER
        if tag in HEADINGS and here == OTHER and len(stack) > 1 and stack[-1][0] == "header" and stack[-2][1] == ARTICLE:
            # an article's own title
            stack.append((tag, ARTICLE))
            here = ARTICLE
            continue
        if tag in BLOCKS and tag not in HEADINGS and tag not in ("p", "li") or says != UNKNOWN or tag in ("p", "li") and here == OTHER:
            now = OTHER if OTHER in (here, says) else max(here, says)
            if now != here:
                flush()
            stack.append((tag, now))
            here = now
    if at < len(page) and not hidden:
        parts.append(page[at:])
    flush()
    return out


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """The rows of the table of lengths of common subsequences of the beginnings of a and b: one big integer each, whose zero
    bits mark where the length grows along b."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = now = (1 << len(b)) - 1
    for line in a:
        hit = now & places.get(line, 0)
        now = ((now + hit) | (now - hit)) & full
        yield now


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b."""
    last = (1 << len(b)) - 1
    for last in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list[str], b: list[str]) -> list[bool]:
    """For each of a whether it is in a longest common subsequence of a and b.  Tables beyond `CELLS` are divided at the middle of a and where b fits
    that best, so memory grows with the lengths, not with their product."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > 1 and len(a) * len(b) > CELLS:
        middle = len(a) // 2
        cut = int(np.argmax(_lengths(a[:middle], b) + _lengths(a[:middle - 1 if middle else None : -1], b[::-1])[::-1]))
        inner = common(a[:middle], b[:cut]) + common(a[middle:], b[cut:])
    else:
        inner = [False] * len(a)
        table = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if table[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or table[i - 1] >> (j - 1) & 1:
                    j -= 1
                    inner[i] = True
    return [True] * start + inner + [True] * end


def main_text(own: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> tuple[str, int, list[int]]:
    """The text that stays of a page, how many blocks are shared with the neighbour that told, and which of the blocks that stay are prose of an article that a neighbour which is
    no copy has too.  others: blocks of the neighbours, the nearest first."""
    best = max((says for _, says in own), default=UNKNOWN)
    marked = best >= PART
    able = [says >= PART if marked else says != OTHER for _, says in own]
    lines = [t for t, _ in own]
    size = sum(len(t) for t, ok in zip(lines, able) if ok)
    found = [common(lines, [t for t, _ in other]) for other in others]
    sizes = [sum(len(t) for t, s, ok in zip(lines, shared, able) if s and ok) for shared in found]
    for most in COPY if marked else COPY_OF_ALL:
        for shared, n in zip(found, sizes):
            if n < most * size:
                stay = [(t, says) for (t, says), s, ok in zip(own, shared, able) if ok and (says >= ARTICLE or not s)]
                theirs = {t for other, m in zip(others, sizes) if m < most * size for t, _ in other} if marked else ()
                return "\n\n".join(t for t, _ in stay), sum(shared), [i for i, (t, says) in enumerate(stay) if says == ARTICLE and t in theirs]
    return "\n\n".join(t for (t, says), ok in zip(own, able) if ok and (marked or says == best)), 0, []


def notices(rows: DataFrame) -> DataFrame:
    """(host, notices): for each host that has any, the keys of its notices.  rows: host, page, html.  Less than (paragraphs of a host's mean page / NOTICE) lines of a host are notices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            prose = [list({t for t, says in blocks(x) if says == ARTICLE}) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(prose, pa.list_(pa.string()))], names=["host", "page", "prose"])

    prose = rows.select("host", "page", "html").mapInArrow(run, "host string, page long, prose array<string>")
    on = prose.select("host", "page", F.explode(F.transform("prose", lambda x: F.xxhash64(x))).alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= NOTICE_PAGES)
    totals = rows.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    return on.join(totals, "host").where(F.col("n") / F.col("pages") > NOTICE).groupBy("host").agg(F.collect_list("line").alias("notices"))


def without_notices(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts (host, text, doubts) without those of their doubtful blocks that are notices of the host; found: a written table of notices()."""
    few = found.agg(F.coalesce(F.sum(F.size("notices")), F.lit(0))).first()[0] + found.count() <= FEW_ROWS
    joined = texts.join(F.broadcast(found) if few else found.hint("merge"), "host", "left")
    kept = F.filter(F.split("text", "\n\n", -1), lambda x, i: ~(F.array_contains("doubts", i) & F.array_contains("notices", F.xxhash64(x))))
    return joined.withColumn("text", F.when(F.col("notices").isNotNull() & (F.size("doubts") > 0), F.array_join(kept, "\n\n")).otherwise(F.col("text")))


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _bordering(marks: DataFrame) -> list[tuple[str, int]]:
    """(key, range): the pages of other ranges that a range needs, two at most.  marks: key, host, page, range.

    The neighbour of a range's first page is the last one before it with another html.  Among the ends of the ranges before, a few rows for
    each, that one is found: the last page of a range, or the last one there that differs from it."""
    row = F.struct("key", "host", "page")
    ends = written(marks.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last")))
    unlike = lambda end: F.when(F.col("page") != F.col(f"{end}.page"), row)
    inner = marks.join(F.broadcast(ends), "range").groupBy("range").agg(F.min(unlike("first")).alias("second"), F.max(unlike("last")).alias("forelast"))
    found = ends.join(inner, "range").orderBy("range").collect()
    out = []
    for step, end in ((1, "first"), (-1, "last")):
        passed: list = []  # the nearest is the last
        for r in found[::step]:
            for x in reversed(passed):
                if x["host"] != r[end]["host"]:
                    break
                if x["page"] != r[end]["page"]:
                    out.append((x["key"], r["range"]))
                    break
            if r["second"] is not None:
                passed = []  # there are two different pages here, so nothing before them is reached
            passed += sorted({r[c] for c in ("first", "second", "forelast", "last") if r[c] is not None}, key=lambda x: x["key"], reverse=step == -1)
    return out


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ranges: int | None = None) -> DataFrame:
    """(id_col, url_col, text, n_blocks, n_shared): each page's main text, its blocks, and those shared with the neighbour that told.  ranges: how many pages
    are dealt out to."""
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = F.xxhash64(text)
    key = F.concat_ws("\x00", host, path, F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(page))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), key.alias("key"), page.alias("page"), text.alias("html"))
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(BORDER_SAMPLE * ranges).toPandas()["key"].tolist()
    drawn.sort(key=str.encode)
    cuts = [x.encode() for x in dict.fromkeys(drawn[BORDER_SAMPLE - 1 :: BORDER_SAMPLE])]

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, k.encode()) for k in keys.to_pylist()], pa.int32())

    marks = written(rows.select("key", "host", "page", range_of("key").alias("range")))
    context = _bordering(marks)
    context = spark.createDataFrame(context, "key string, range int").groupBy("key").agg(F.collect_set("range").alias("elsewhere"))
    # at most two rows for each range
    dealt = rows.withColumn("own", range_of("key")).join(F.broadcast(context), "key", "left")
    dealt = dealt.withColumn("range", F.explode(F.array_union(F.array("own"), F.coalesce("elsewhere", F.array().cast("array<int>")))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def different() -> Iterator[tuple]:
            """(host, page, blocks, members) of runs of pages with the same html; members: (id, url, path, is it this range's)."""
            now = None
            for batch in chunks(batches, "html"):
                for row in batch.to_pylist():
                    if now is None or (row["range"], row["host"], row["page"]) != now[:3]:
                        if now is not None:
                            yield now
                        now = (row["range"], row["host"], row["page"], blocks(row["html"]), [])
                    now[4].append((row["id"], row["url"], row["key"].split("\x00")[1], row["own"] == row["range"]))
            if now is not None:
                yield now

        def results(before: tuple | None, run: tuple, after: tuple | None) -> Iterator[tuple]:
            near = [(x, x[4][k][2]) for x, k in ((before, -1), (after, 0)) if x is not None and x[:2] == run[:2]]
            told: dict[int, tuple] = {}
            for id_, url, path, own in run[4]:
                if own:
                    first = int(len(near) == 2 and _prefix(near[1][1], path) > _prefix(near[0][1], path))
                    if first not in told:
                        told[first] = main_text(run[3], [x[3] for x, _ in (near[::-1] if first else near)])
                    yield id_, url, run[1], told[first][0], len(run[3]), *told[first][1:]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "url", "host", "text", "n_blocks", "n_shared", "doubts"])

        before = now = None
        for after in chain(different(), [None]):
            if now is not None:
                for row in results(before, now, after):
                    out.append(row)
                    size += len(row[3])
                    if size > 4 << 20:
                        yield packed(out)
                        out, size = [], 0
            before, now = now, after
        if out:
            yield packed(out)

    kind = pages.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(pages.schema[id_col].dataType)
    ordered = dealt.select("id", "url", "host", "key", "page", "html", "own", "range").repartition("range").sortWithinPartitions("range", "key")
    texts = ordered.mapInArrow(run, f"id {kind}, url string, host string, text string, n_blocks long, n_shared long, doubts array<int>")
    out = without_notices(texts, written(notices(rows)))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_blocks", "n_shared")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_texts(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
