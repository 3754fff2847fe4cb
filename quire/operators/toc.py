"""Tables of contents: detection, row reading, confidence, strategy, page offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import toc as T
from quire.functions.text import LINE_BREAK, strip
from quire.operators.layout import page_band_filter
from quire.operators.ordered import block_of, dense_number, first_rows

PAGE = ["doc_id", "page_index"]
MAX_SCAN_PAGES = 15
MAX_OFFSET = 80
MIN_STREAK = 5


def toc_page_features(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, *[c.alias(n) for n, c in T.page_features(F.col("text")).items()])


def toc_page_type(pages: DataFrame, max_scan: int = MAX_SCAN_PAGES) -> DataFrame:
    """Contents pages among the first ``max_scan`` pages of each document."""
    return (
        pages.where(F.col("page_index") < max_scan)
        .select(*PAGE, T.page_type(F.col("page_index"), F.col("text")).alias("toc_type"))
        .where("toc_type is not null")
    )


def toc_first_hit(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(
        F.min_by("toc_type", "page_index").alias("toc_type"), F.min("page_index").alias("toc_page_index"))


def toc_rows(blocks: DataFrame, y_tol: int = 4) -> DataFrame:
    """Text boxes of a page to visual rows: boxes within a height bucket, joined left to right."""
    lines = blocks.select(
        *PAGE, "block_no", "x0", (F.bround(F.col("y0") / y_tol) * y_tol).alias("y_key"),
        F.posexplode(F.split("text", "\n")).alias("line_pos", "line"),
    ).withColumn("line", strip(F.col("line"))).where("line <> ''")
    parts = F.array_sort(F.collect_list(F.struct("x0", "block_no", "line_pos", "line")))
    return lines.groupBy(*PAGE, "y_key").agg(
        strip(F.array_join(F.transform(parts, lambda p: p["line"]), " ")).alias("row_text"))


def toc_row_score(rows: DataFrame, least: int = 4) -> DataFrame:
    return rows.groupBy(*PAGE).agg(F.sum(T.row_points(F.col("row_text"))).alias("score")).withColumn(
        "is_toc", F.col("score") >= least)


def toc_text_score(pages: DataFrame, least: int = 3) -> DataFrame:
    score = F.aggregate(F.split("text", LINE_BREAK), F.lit(0), lambda acc, l: acc + T.line_points(l))
    named = F.contains(F.lower("text"), F.lit("content"))
    return pages.select(*PAGE, score.alias("score"), named.alias("_named")).select(
        *PAGE, "score", (F.col("_named") | (F.col("score") >= least)).alias("is_toc"))


def toc_page_run(scored: DataFrame, starts: DataFrame, max_pages: int | None = MAX_SCAN_PAGES) -> DataFrame:
    """Consecutive contents pages from the start page, up to the first page that is none.

    ``scored`` holds every page with ``is_toc``; only minima per document are needed.
    """
    s = scored.join(starts.select("doc_id", F.col("toc_page_index").alias("_start")), "doc_id").where(
        F.col("page_index") >= F.col("_start"))
    if max_pages is not None:
        s = s.where(F.col("page_index") < F.col("_start") + max_pages)
    stops = s.where(~F.col("is_toc")).groupBy("doc_id").agg(F.min("page_index").alias("_stop"))
    return s.where("is_toc").join(stops, "doc_id", "left").where(
        F.col("_stop").isNull() | (F.col("page_index") < F.col("_stop"))).select(*PAGE)


def toc_entries(rows: DataFrame) -> DataFrame:
    return rows.select(*PAGE, "y_key", T.entry(F.col("row_text")).alias("e")).where("e is not null").select(
        *PAGE, "y_key", "e.*")


def toc_confidence(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Six counts, weighted score (never below 0) and HIGH / MEDIUM / LOW."""
    level, label = F.coalesce("level", F.lit("unknown")), F.coalesce("page_label", F.lit(""))
    points = F.lit(1) + F.when(label != "", 2).otherwise(0)
    known = F.lit(T.LEVEL_POINTS["unknown"])
    for name in T.LEVELS[:3]:
        known = F.when(level == name, T.LEVEL_POINTS[name]).otherwise(known)
    out = entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(level == "chapter").alias("chapters"),
        F.count_if(level == "section").alias("sections"),
        F.count_if(level == "subsection").alias("subsections"),
        F.count_if(~level.isin(*T.LEVELS[:3])).alias("unknowns"),
        F.count_if(label != "").alias("page_labels"),
        F.greatest(F.sum(points + known), F.lit(0)).cast("long").alias("score"),
    )
    return out.withColumn("level", F.when(F.col("score") >= 40, "HIGH").when(F.col("score") >= 20, "MEDIUM")
                          .otherwise("LOW"))


def toc_label_sort(entries: DataFrame, position: str = "pos", key: str = "doc_id") -> DataFrame:
    """Order entries of a document by label, then position; ``rank`` is 1-based. ``position`` is a
    number; label values and positions make the blocks, so a long list is not sorted in one task."""
    k = T.label_sort_key(F.col("page_label"))
    group, value = F.coalesce(k["label_group"], F.lit(2)), F.coalesce(k["label_value"], F.lit(-1).cast("long"))
    keyed = entries.withColumns({"_g": group, "_v": value})
    block = F.struct(F.col("_g").alias("g"), F.col("_v").alias("v"), F.floor(F.col(position) / 65536).alias("p"))
    ranked = dense_number(keyed, [key], block, [F.col("_g"), F.col("_v"), F.col(position)], "rank", start=1)
    return ranked.select(key, F.col("rank").cast("int").alias("rank"), "title", "page_label", "level")


def logical_pages(entries: DataFrame) -> DataFrame:
    """Distinct numeric page labels; zero and unreadable labels do not count."""
    return entries.select("doc_id", T.label_to_int(F.col("page_label")).alias("logical_page")).where(
        F.col("logical_page") != 0).distinct()


def page_number_candidates(blocks: DataFrame) -> DataFrame:
    """Numbers printed in the top or bottom fifth of each page, in reading order."""
    pages = blocks.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
    return page_band_filter(blocks).join(pages, "doc_id").select(
        "doc_id", F.col("page_index").alias("phys"),
        F.posexplode(T.number_candidates(F.col("text"), F.col("page_count"))).alias("pos", "printed"))


def _with_offset(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("offset", (F.col("phys") - F.col("printed") + 1).cast("long"))


def offset_votes(candidates: DataFrame, top: int = 5) -> DataFrame:
    """The most voted offsets per document; the one seen first wins a tie."""
    votes = _with_offset(candidates).groupBy("doc_id", "offset").agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct("phys", "pos")).alias("first_seen"))
    return first_rows(votes, ["doc_id"], [F.col("votes").desc(), F.col("first_seen")], top, rank="rank").drop(
        "first_seen")


def offset_join(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """Pages that show the number a candidate offset expects: an equality on (document, offset)."""
    shown = _with_offset(candidates).select("doc_id", "phys", "offset").distinct()
    return shown.join(votes.select("doc_id", "offset", "rank"), ["doc_id", "offset"])


def offset_streak(candidates: DataFrame, top: int = 5, least: int = MIN_STREAK,
                  max_offset: int = MAX_OFFSET) -> DataFrame:
    """The offset with the longest run of matching pages, over pages that show any number.

    Runs are gaps-and-islands over page ranks; both numberings are block-wise, so a document of
    any length is never sorted in one task.
    """
    votes = offset_votes(candidates, top)
    ranks = dense_number(candidates.select("doc_id", "phys").distinct(), ["doc_id"], block_of("phys"),
                         [F.col("phys")], "page_rank")
    hits = offset_join(candidates, votes).join(ranks, ["doc_id", "phys"])
    hits = dense_number(hits, ["doc_id", "offset"], block_of("page_rank"), [F.col("page_rank")], "hit_rank")
    runs = hits.groupBy("doc_id", "offset", "rank", (F.col("page_rank") - F.col("hit_rank")).alias("island")).agg(
        F.count(F.lit(1)).alias("streak"))
    best = runs.groupBy("doc_id").agg(
        F.max_by(F.struct("offset", "streak"), F.struct(F.col("streak"), -F.col("rank"))).alias("b"))
    return best.select("doc_id", "b.offset", "b.streak").where(
        (F.col("streak") >= least) & (F.abs("offset") <= max_offset))


def apply_page_offset(rows: DataFrame, offsets: DataFrame, physical: str = "page_physical") -> DataFrame:
    """Printed label of a physical page: physical minus the document's offset."""
    return rows.join(offsets.select("doc_id", "offset"), "doc_id", "left").withColumn(
        "page_label", (F.col(physical) - F.col("offset")).cast("string")).drop("offset")
