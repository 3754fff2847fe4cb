"""From spans to styled units: font statistics, running headers, roles of font sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.ordered import first_rows, page_block

DOC = ["doc_id"]
POSITION = ("page", "line_no", "span_no")


def _position(df: DataFrame):
    """Reading order of spans as one comparable value."""
    return F.struct(*[c for c in POSITION if c in df.columns])


def text_spans(spans: DataFrame, *, max_pages: int | None = None, after_page: DataFrame | None = None) -> DataFrame:
    """Non-blank spans with rounded size: of the first pages, or of the pages from a start page on."""
    s = spans.where(strip(F.col("text")) != "").withColumn("size", F.bround("size", 1))
    if max_pages is not None:
        s = s.where(F.col("page") <= max_pages)
    if after_page is not None:
        s = s.join(after_page, "doc_id").where(F.col("page") >= F.col("start_page")).drop("start_page")
    return s


def font_stats(spans: DataFrame, max_pages: int | None = 20, after_page: DataFrame | None = None) -> DataFrame:
    """Span count per size and document, with the first place each size is seen."""
    s = text_spans(spans, max_pages=max_pages, after_page=after_page)
    return s.groupBy("doc_id", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min(_position(s)).alias("first_seen"))


def band_limits(*, points: float | None = None, share: float | None = None):
    """Lower edge of the top band and upper edge of the bottom band, by points or page share."""
    h = F.col("page_height")
    return (F.lit(points), h - points) if points is not None else (h * share, h * (1 - share))


def header_footer_detect(spans: DataFrame, max_pages: int | None = 20, band: float = 80.0) -> DataFrame:
    """Lower-case band texts seen on half of the first ``max_pages`` pages of a document, and at least
    three times. Without ``max_pages`` all pages are read, and half of the last page's number counts."""
    top, bottom = band_limits(points=band)
    s = text_spans(spans, max_pages=max_pages)
    seen = s.where((F.col("y0") < top) | (F.col("y1") > bottom)).groupBy(
        "doc_id", F.lower(strip(F.col("text"))).alias("line_key")).agg(F.count(F.lit(1)).alias("n"))
    if max_pages is not None:
        return seen.where(F.col("n") >= max(3, max_pages // 2))
    pages = s.groupBy("doc_id").agg(F.max("page").alias("_pages"))
    return seen.join(pages, "doc_id").where(
        (F.col("n") >= 3) & (F.col("n") >= F.floor(F.col("_pages") / 2))).drop("_pages")


def page_band_filter(blocks: DataFrame, share: float = 0.2) -> DataFrame:
    top, bottom = band_limits(share=share)
    return blocks.where((F.col("y1") < top) | (F.col("y0") > bottom))


def line_units(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spans of a line joined in order; the line's size is the mean span size, one decimal, ties to even.
    ``by`` are columns that a line's spans share and by which they may be dealt out already."""
    return (
        spans.groupBy("doc_id", *by, "page", "line_no")
        .agg(
            strip(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")).alias("text"),
            F.bround(F.avg(F.bround("size", 1)), 1).alias("font_size"),
        )
        .where("text <> ''")
    )


def _size_ranking(stats: DataFrame) -> DataFrame:
    """Per document its sizes, most frequent first, as an array: sizes have one decimal, so there
    are few of them however long the document is. One pass over the statistics."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_seen", "size")))
    return stats.groupBy("doc_id").agg(
        F.transform(order, lambda x: x["size"]).alias("by_count"),
        F.sort_array(F.collect_list("size"), asc=False).alias("by_size"))


def style_sizes(stats: DataFrame) -> DataFrame:
    """Body is the most frequent size, subheading the second most frequent, heading the largest."""
    return _size_ranking(stats).select(
        "doc_id", F.get("by_count", F.lit(0)).alias("body_size"),
        F.coalesce(F.get("by_count", F.lit(1)), F.get("by_count", F.lit(0))).alias("subheading_size"),
        F.get("by_size", F.lit(0)).alias("heading_size"))


def style_sizes_post_toc(stats: DataFrame) -> DataFrame:
    """Chapter is the largest size, subheading the next, body the most frequent; needs two sizes."""
    return _size_ranking(stats).where(F.size("by_size") >= 2).select(
        "doc_id", F.get("by_size", F.lit(0)).alias("chapter_size"),
        F.get("by_size", F.lit(1)).alias("subheading_size"), F.get("by_count", F.lit(0)).alias("body_size"))


def style_samples(spans: DataFrame, sizes: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` spans per role. A span is tried as chapter, then subheading, then body, so a
    size that serves two roles fills the earlier one first."""
    s = text_spans(spans).join(sizes, "doc_id")
    role_sizes = F.array(*[
        F.struct(F.lit(i).alias("role_no"), F.lit(r).alias("role"), F.col(f"{r}_size").alias("role_size"))
        for i, r in enumerate(("chapter", "subheading", "body"))])
    # Per size: its roles in order; the k-th span of a size goes to role number k // n.
    s = s.withColumn("roles", F.filter(role_sizes, lambda x: x["role_size"] == F.col("size")))
    s = s.where(F.size("roles") > 0)
    top = first_rows(s, ["doc_id", "size"], [_position(s)], 3 * n, rank="k")
    slot = F.floor((F.col("k") - 1) / n).cast("int")
    return top.where(slot < F.size("roles")).select(
        "doc_id", F.element_at("roles", slot + 1)["role"].alias("role"),
        ((F.col("k") - 1) % n + 1).cast("int").alias("sample_no"), "page", "line_no", "text")


def unit_type(size: str = "font_size"):
    """Role of a size; where roles share a size, body wins over subheading over heading."""
    s = F.col(size)
    return (
        F.when(s == F.col("body_size"), "body").when(s == F.col("subheading_size"), "subheading")
        .when(s == F.col("heading_size"), "heading").otherwise("body")
    )


def unit_position():
    """Reading order of lines in a document as one number: increasing, not gap-free."""
    return F.shiftleft(F.col("page").cast("long"), 24) + F.col("line_no")


def _styles(spans: DataFrame, max_pages: int | None) -> DataFrame:
    """One row per document: the sizes of its roles, its running headers, and the first and last page block with text."""
    s = text_spans(spans)
    counts = F.lit(True) if max_pages is None else F.col("page") <= max_pages
    stats = s.groupBy("doc_id", "size").agg(
        F.count_if(counts).alias("n"), F.min(F.when(counts, _position(s))).alias("first_seen"),
        F.min(page_block()).alias("_first"), F.max(page_block()).alias("_last"))
    ends = stats.groupBy("doc_id").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    heads = header_footer_detect(spans, max_pages).groupBy("doc_id").agg(F.collect_list("line_key").alias("_heads"))
    return style_sizes(stats.where("n > 0")).join(ends, "doc_id").join(heads, "doc_id", "left")


def styled_units(spans: DataFrame, max_pages: int | None = 20) -> DataFrame:
    """Lines of all pages, without running headers, typed by size, with their position. Headers and
    sizes are learned from the first ``max_pages`` pages, or from all of them without that.

    Spans are dealt out by document and page block once. What is learned of a document goes to each of its blocks as one
    row, so that no line moves again; ``_pages``, ``_first`` and ``_last`` (its block, and the ends of the document's) tell
    later steps so."""
    lines = line_units(spans.withColumn("_pages", page_block()).repartition("doc_id", "_pages"), ["_pages"])
    styles = _styles(spans, max_pages).withColumn("_pages", F.explode(F.sequence("_first", "_last")))
    kept = lines.join(styles, ["doc_id", "_pages"]).where(
        F.col("_heads").isNull() | ~F.array_contains("_heads", F.lower("text")))
    return kept.select(
        "doc_id", "page", unit_position().alias("unit_no"), "text", "font_size", unit_type().alias("type"), "_pages", "_first", "_last")
