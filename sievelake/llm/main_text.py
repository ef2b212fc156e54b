"""Main text of web pages: every page is compared with the page of its host whose URL path is nearest.

The lines of both pages are aligned by their longest common subsequence, and shared lines are deleted: they are the host's
template. Two things make that right for pages as they are. A part that the page itself marks (a menu, a footer, an advert and
so on) is one line of the alignment whatever it says, since its entries differ from page to page, and goes even if the other page
has none. And lines of an article element take no part: what an article says stays, also when the neighbour quotes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.alignment import common
from sievelake.llm.markup import Line, lines_of
from sievelake.llm.merkle import row_digest
from sievelake.llm.words import pieces
from sievelake.session import cut_lineage

#: Shares of a page's open text that it has in common with its neighbour: from the first on, a line must be shared with the
#: page on the other side as well; from the second on, the neighbour is a copy and the other side's page is used instead.
DOUBTFUL, COPY = 0.5, 0.9
LINES = "names array<long>, sizes array<int>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def candidates(lines: list[Line]) -> list[tuple[str, int]]:
    """What takes part in the alignment: a text and its length for open lines, a name and 0 for each marked region."""
    scope = _scope(lines)
    out: list[tuple[str, int]] = []
    last = 0
    for line in lines:
        if line.label and line.region != last:
            out.append((f"<{line.label}>", 0))
        elif not line.label and scope(line) and not line.article:
            out.append((line.text, len(line.text)))
        last = line.region if line.label else 0
    return out


def _scope(lines: list[Line]):
    """Which lines can be main text: those of articles, else of main parts, else all."""
    if any(x.article for x in lines):
        return lambda x: x.article
    if any(x.main and not x.label for x in lines):
        return lambda x: x.main
    return lambda x: True


def main_text(lines: list[Line], gone: set[int]) -> str:
    """Lines that no mark excludes, without the open ones whose numbers among the candidates are in `gone`."""
    scope, kept, number, last = _scope(lines), [], -1, 0
    for line in lines:
        if line.label:
            number += line.region != last
            last = line.region
            continue
        last = 0
        if line.article:
            kept.append(line.text)
        elif scope(line):
            number += 1
            if number not in gone:
                kept.append(line.text)
    return "\n".join(kept)


def shared_lines(own: list[int], sizes: list[int], near: list[int] | None, far: list[int] | None) -> tuple[list[int], int]:
    """Numbers of lines to delete, and how many the page used for it (0: none, 1: near, 2: far, 3: both) has in common."""
    whole = sum(sizes)

    def with_page(other: list[int] | None) -> tuple[set[int], float]:
        same = {i for i, _ in common(own, other)} if other else set()
        return same, sum(sizes[i] for i in same) / whole if whole else 0.0

    same, share = with_page(near)
    if share < DOUBTFUL:
        return sorted(same), 1 if near is not None else 0
    beyond, more = with_page(far)
    if share < COPY:
        return (sorted(same & beyond), 3) if far is not None else (sorted(same), 1)
    return (sorted(beyond), 2) if far is not None and more < COPY else ([i for i in sorted(same) if not sizes[i]], 0)


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        names, sizes = [], []
        for page in batch.column("html").to_pylist():
            units = candidates(lines_of(page))
            names.append([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t, _ in units])
            sizes.append([n for _, n in units])
        kept = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(names, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], [*kept, "names", "sizes"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, used = [], []
        for r in batch.to_pylist():
            lines, page = shared_lines(r["names"], r["sizes"], r["near"], r["far"])
            gone.append(lines)
            used.append(page)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32())), pa.array(used, pa.int32())], ["key", "gone", "used"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(lines_of(page), set(gone or ())) for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        shared = [len(g or ()) for g in batch.column("gone").to_pylist()]
        kept = [n for n in batch.schema.names if n not in ("html", "gone")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(texts, pa.string()), pa.array(shared, pa.int32())], [*kept, "text", "n_shared"])


def _neighbours(narrow: DataFrame) -> DataFrame:
    """Distinct pages with the lines of the nearest page of their host (`near`) and of the one on the other side (`far`).

    The page with the longest common beginning of its path is next to a page in the order of paths. Ranges of that order are
    written with the rows; inside a range, rows look at the ones before and after, and of each range only the first and last
    row meet the ranges beside it. So a host of any size is spread over its ranges.
    """
    order = ["path", "url", "key"]
    ranged = cut_lineage(narrow.repartitionByRange("host", *order).withColumn("range", F.spark_partition_id()))
    page = F.struct("path", "names")
    inside = Window.partitionBy("host", "range").orderBy(*[F.asc_nulls_first(c) for c in order])
    placed = ranged.withColumn("prev", F.lag(page).over(inside)).withColumn("next", F.lead(page).over(inside))
    spot = F.struct(*[F.col(c) for c in order])
    ends = ranged.groupBy("host", "range").agg(F.min_by(page, spot).alias("first"), F.max_by(page, spot).alias("last"))
    beside = Window.partitionBy("host").orderBy("range")
    edges = ends.select("host", "range", F.lag("last").over(beside).alias("_before"), F.lead("first").over(beside).alias("_after"))
    joined = placed.join(edges, ["host", "range"])
    prev, following = F.coalesce("prev", "_before"), F.coalesce("next", "_after")
    joined = joined.select("key", "path", "names", "sizes", prev.alias("prev"), following.alias("next"))
    alike = lambda other: F.coalesce(_common_start(F.col("path"), other), F.lit(-1))
    left = alike(F.col("prev.path")) >= alike(F.col("next.path"))
    return joined.select("key", "names", "sizes", F.when(left, F.col("prev.names")).otherwise(F.col("next.names")).alias("near"), F.when(left, F.col("next.names")).otherwise(F.col("prev.names")).alias("far"))


def _common_start(a: Column, b: Column) -> Column:
    """Bytes that two texts have in common at their start; null where one of them is null."""
    pairs = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    differs = F.filter(pairs, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    shorter = F.least(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(shorter == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, shorter))


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, url, text (empty if none), n_chars (code points) and n_shared (lines and regions deleted because the neighbour has
    them) of every page row.

    A null html is empty; a null or odd URL has the empty host or path, and such pages are neighbours of each other. Repeated
    rows are one page in comparisons and all come back. A page alone on its host loses only what it marks itself, and so does
    one whose neighbours on both sides are copies of it. Empty tables give no rows; other columns are left out.
    """
    rows = pages.select(F.col(f"`{page}`").alias("page"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    keyed = rows.withColumn("key", row_digest([F.col("page"), F.col("url"), F.col("html")]))
    schema = f"key binary, host string, path string, url string, {LINES}"
    narrow = keyed.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url", "html").mapInArrow(_list_lines, schema)
    aligned = _neighbours(cut_lineage(narrow).dropDuplicates(["key"])).mapInArrow(_align, "key binary, gone array<int>, used int")
    gone = cut_lineage(aligned)
    whole = keyed.join(gone, "key", "left").select("page", "url", "html", "gone")
    kind = rows.schema["page"].dataType.simpleString()
    out = whole.mapInArrow(_extract, f"page {kind}, url string, text string, n_shared int")
    return out.select(F.col("page").alias(page), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
