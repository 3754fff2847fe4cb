"""Contents of whole documents in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import toc as TF
from quire.operators import toc as T
from quire.session import materialise


def toc_documents(pages: DataFrame, blocks: DataFrame, number_candidates: DataFrame,
                  generated: DataFrame | None = None) -> DataFrame:
    """Detect, read, score, choose, and find the page offset.

    ``generated`` (``doc_id, page_index, raw``) is the text a model made of each contents page; it
    stands in where the rules are not confident. One row per document with a contents page.
    """
    start = materialise(T.toc_first_hit(T.toc_page_type(pages)))
    # Only the pages a contents list may cover are read into rows.
    near = (F.col("page_index") >= F.col("toc_page_index")) & (
        F.col("page_index") < F.col("toc_page_index") + T.MAX_SCAN_PAGES)
    pages = pages.join(start.select("doc_id", "toc_page_index"), "doc_id").where(near).drop("toc_page_index")
    rows = materialise(T.toc_rows(blocks.join(start.select("doc_id", "toc_page_index"), "doc_id").where(near)))
    all_pages = pages.select(*T.PAGE).join(T.toc_row_score(rows), T.PAGE, "left").withColumn(
        "is_toc", F.coalesce("is_toc", F.lit(False)))
    run = T.toc_page_run(all_pages, start)
    entries = T.toc_entries(rows.join(run, T.PAGE, "left_semi")).withColumn(
        "pos", F.struct("page_index", "y_key"))
    scored = T.toc_confidence(entries)
    rule = _as_array(entries, F.col("pos")).withColumnRenamed("entries", "rule_entries")
    out = start.join(scored.select("doc_id", "score", F.col("level").alias("confidence")), "doc_id", "left") \
        .withColumns({"score": F.coalesce("score", F.lit(0)), "confidence": F.coalesce("confidence", F.lit("LOW"))})
    out = out.withColumn("strategy", TF.strategy(F.col("toc_type"), F.col("confidence"))).join(rule, "doc_id", "left")
    chosen: Column = F.col("rule_entries")
    if generated is not None:
        text_run = T.toc_page_run(T.toc_text_score(pages), start)
        parsed = generated.join(text_run, T.PAGE, "left_semi").select(
            "doc_id", "page_index", F.posexplode(TF.parse_entries(F.col("raw"))).alias("i", "e")).select(
            "doc_id", (F.shiftleft(F.col("page_index").cast("long"), 24) + F.col("i")).alias("pos"), "e.*")
        fallback = _as_array(T.toc_label_sort(parsed), F.col("rank")).withColumnRenamed("entries", "fallback_entries")
        out = out.join(fallback, "doc_id", "left")
        chosen = F.when(F.col("strategy") == "rule", chosen).otherwise(F.col("fallback_entries"))
    empty = F.array().cast(f"array<{TF.ENTRY}>")
    offsets = T.offset_streak(number_candidates)
    return out.join(offsets.select("doc_id", "offset"), "doc_id", "left").select(
        "doc_id", "toc_type", (F.col("toc_page_index") + 1).alias("toc_page"), "toc_page_index",
        "confidence", "strategy", "offset", F.coalesce(chosen, empty).alias("toc_entries"))


def _as_array(entries: DataFrame, position: Column) -> DataFrame:
    """Entries of at most 15 pages per document, in order."""
    items = F.array_sort(F.collect_list(F.struct(position.alias("p"), "title", "page_label", "level")))
    return entries.groupBy("doc_id").agg(F.transform(
        items, lambda e: F.struct(e["title"].alias("title"), e["page_label"].alias("page_label"),
                                  e["level"].alias("level"))).alias("entries"))
