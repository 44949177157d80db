"""Main text of web pages by differencing each page with its nearest neighbour.

Pages are ordered by URL path within their host. A page is aligned, line by
line, with the nearest page before it, else after it, by a longest common
subsequence; shared lines are the template and are deleted. A neighbour that
shares nearly all lines is a copy, which tells nothing of the template: the next
one takes its place, and of a page with copies only beside it nothing is deleted.

Two guards come from the markup, as differencing alone is wrong in two ways: a
page's own article may quote or copy its neighbour's, so lines inside a
declared article stay even if shared; and menus or adverts may differ from
page to page, so lines that an element declares as such go even if not shared.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.hashing import slices
from shelfcast.llm.page_lines import CONTENT, DECLARED, OPEN, common_lines, page_lines
from shelfcast.llm.scratch import Scratch

#: Pages in a range of URLs, at most, and the number of ranges that smaller tables have, about.
RANGE_PAGES = 50_000
LEAST_RANGES = 64
#: Pages before, and pages after, among which a page's neighbour is looked for.
NEIGHBOURS = 8
#: A neighbour that has so large a share of a page's lines is a copy of it.
COPY = 0.9
_LINES = "id long, url string, host string, path string, tie long, range long, extra boolean, lines array<string>, kinds array<tinyint>"
_TEXT = "id long, url string, text string, n_chars long, n_shared long, n_declared long"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def _key(host, path, ident, tie) -> tuple:
    return host.encode(), path.encode(), ident is not None, ident or 0, tie


def _parse(cuts: list[tuple], edges: dict[tuple, list[int]]):
    """Lines of each page, dealt to its range; the pages at a range's edges also to the range beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _LINES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(),
                 pa.list_(pa.string()), pa.list_(pa.int8())]
        for piece in slices(batches, "html", 4 << 20):
            rows = []
            for ident, url, host, path, tie, page in zip(*(piece.column(c).to_pylist() for c in ("id", "url", "host", "path", "tie", "html"))):
                lines = page_lines(page or "")
                key = _key(host, path, ident, tie)
                own = bisect_right(cuts, key)
                for at in (own, *{x for x in edges.get(key, ()) if x != own}):
                    rows.append((ident, url, host, path, tie, at, at != own, [x for x, _ in lines], [x for _, x in lines]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and in URL order; a page waits until those after it are known."""

    def emit(row: tuple, shared: set[int]) -> tuple:
        ident, url, _, _, _, lines, kinds = row
        kept = [t for i, (t, k) in enumerate(zip(lines, kinds)) if k == CONTENT or (k == OPEN and i not in shared)]
        template = sum(k != CONTENT for i, k in enumerate(kinds) if i in shared)
        declared = sum(k == DECLARED and i not in shared for i, k in enumerate(kinds))
        text = "\n\n".join(kept)
        return ident, url, text, len(text), template, declared

    def shared(row: tuple, beside: list[tuple]) -> set[int]:
        """Places of the lines shared with the first of the neighbours that is no copy; none where all are."""
        for other in beside:
            if (other[2], other[3]) == (row[2], row[3]):
                found = common_lines(row[5], other[5])
                if len(found) < COPY * len(row[5]):
                    return found
        return set()

    before, waiting, out = deque(maxlen=NEIGHBOURS), deque(), []
    names = [x.split()[0] for x in _TEXT.split(", ")]
    kinds_of = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def settle() -> None:
        row = waiting.popleft()
        if not row[4]:
            after = [x for x, _ in zip(waiting, range(NEIGHBOURS))]
            out.append(emit(row, shared(row, [*reversed(before), *after])))
        before.append(row)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("id", "url", "host", "range", "extra", "lines", "kinds")]
        for row in zip(*columns):
            waiting.append(row)
            if len(waiting) > NEIGHBOURS:
                settle()
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds_of)], names=names)
                out.clear()
    while waiting:
        settle()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds_of)], names=names)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars, n_shared, n_declared) of every page.

    ``text`` joins the kept blocks in page order by two newlines; n_shared
    lines were deleted as shared with the neighbour, n_declared by markup alone.

    Defined cases: null or empty html gives an empty text; a null url is a page
    of an unnamed host; where the NEIGHBOURS pages of its host before and after a page
    are all copies of it, or it is its host's only one, only its markup
    decides; of rows that repeat a URL the one with the smaller id comes first,
    and rows that repeat all stay. Other columns are not read. An empty table
    gives no rows.

    Results don't depend on the ranges: a range also gets the pages next to it. The driver holds
    2 * NEIGHBOURS keys (URL and id) for each range of RANGE_PAGES pages.
    """
    spark = pages.sparkSession
    source = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    source = source.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "tie": F.xxhash64("url")})
    order = ["host", "path", F.asc_nulls_first("id"), "tie"]
    with Scratch(spark) as tmp:
        keys = source.select("host", "path", "id", "tie").orderBy(*order)
        # A generated id counts rows within a task, here in sorted order; written, it is fixed.
        keys = tmp.write(keys.withColumn("place", F.monotonically_increasing_id()), "urls")
        part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        counts = sorted((p, n) for p, n in keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        total = sum(n for _, n in counts)
        size = max(2 * NEIGHBOURS, min(RANGE_PAGES, -(-total // LEAST_RANGES)))
        offsets, at = [], 0
        for p, n in counts:
            offsets.append((p, at))
            at += n
        cuts, edges = [], {}
        if offsets:
            starts = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))  # one row for each task
            ranked = keys.withColumn("part", part.cast("long")).join(starts, "part").withColumn("rank", F.col("offset") + row)
            inside = F.col("rank") % size
            ends = ranked.where((inside < NEIGHBOURS) | (inside >= size - NEIGHBOURS))
            for r in sorted(ends.select("host", "path", "id", "tie", "rank").collect(), key=lambda r: r["rank"]):
                key, own, inside = _key(r["host"], r["path"], r["id"], r["tie"]), r["rank"] // size, r["rank"] % size
                if own and not inside:
                    cuts.append(key)
                if own and inside < NEIGHBOURS:
                    edges.setdefault(key, []).append(own - 1)
                if inside >= size - NEIGHBOURS:
                    edges.setdefault(key, []).append(own + 1)
        # With rows that repeat a key, a range's number is found by its cut; equal cuts leave empty ranges.
        lines = source.mapInArrow(_parse(cuts, edges), _LINES)
        ranges = len(cuts) + 1
        dealt = lines.repartition(ranges, "range").sortWithinPartitions("range", *order)
        out = dealt.mapInArrow(_difference, _TEXT)
        return out.withColumnsRenamed({"id": id_col, "url": url_col})
