"""Chunks out of styled units: sections, greedy fill, overlap, validity, ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import strip
from quire.operators.ordered import (
    BLOCK, PAGES_PER_BLOCK, block_of, dense_number, drop_halo, join_null_safe, neighbours, page_block, running, with_halo)
from quire.session import materialise

DOC = ["doc_id"]
MAX_CHARS = 1500
OVERLAP = 300
MIN_CHARS = 50
SHORT_SECTION = 256      # units of a section folded in one JVM expression
BLOCKS_PER_SCAN = 1024   # blocks whose chunk counts are summed together
PLACE = ["_pages", "_first", "_last"]


def _placed(units: DataFrame) -> DataFrame:
    """Units with their page block and the first and last one of their document, as ``styled_units`` leaves them."""
    if set(PLACE) <= set(units.columns):
        return units
    units = units.withColumn("_pages", page_block())
    ends = units.groupBy(*DOC).agg(F.min("_pages").alias("_first"), F.max("_pages").alias("_last"))
    return join_null_safe(units, ends, DOC)


def section_ids(units: DataFrame) -> DataFrame:
    """Number the sections of each document: every heading or subheading opens one.

    Adds ``section``, the heading in force, the section's own subheading and its first page.
    Section 0 is the text before the first heading.
    """
    dealt = set(PLACE) <= set(units.columns)
    units = _placed(units).withColumn("text", strip(F.col("text"))).where("text <> ''")
    opens = F.col("type").isin("heading", "subheading")
    out = running(
        units, DOC, "unit_no",
        sums={"section": opens.cast("long")},
        lasts={
            "_head": F.when(opens, F.struct("type", "text", "page")),
            "chapter": F.when(F.col("type") == "heading", F.col("text")),
        },
        block=F.col("_pages"), dealt=dealt,
    )
    return out.select(
        *units.columns, "section", "chapter",
        F.when(F.col("_head.type") == "subheading", F.col("_head.text")).alias("subheading"),
        F.col("_head.page").alias("section_page"),
    )


def _pieces(units: DataFrame) -> DataFrame:
    """What each unit adds to the buffer: a subheading is prefixed by the heading in force."""
    prefix = (F.col("type") == "subheading") & F.col("chapter").isNotNull()
    text = F.when(prefix, F.concat("chapter", F.lit("\n"), "text")).otherwise(F.col("text"))
    return units.withColumn("piece", text).withColumn("piece_len", F.length(text) + 1)


def fill_starts(lengths: np.ndarray, limit: int, carry: int = 0) -> tuple[np.ndarray, int]:
    """Greedy fill of one block: for each unit the number of chunks closed before it, counted from
    the block's start, and the length left open at the end."""
    total = np.cumsum(lengths)
    closed = np.zeros(len(lengths), dtype=np.int64)
    base, n, at = -carry, 0, 0
    while at < len(lengths):
        end = int(np.searchsorted(total, base + limit, side="left"))
        closed[at:end + 1] = n
        if end >= len(lengths):
            break
        base, n, at = int(total[end]), n + 1, end + 1
    left = (int(total[-1]) - base) if len(lengths) else carry
    return closed, left


def carry_map(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Open length after the block for every open length ``0..limit-1`` before it."""
    total = np.cumsum(lengths)
    n = len(lengths)
    after = np.empty(n + 1, dtype=np.int64)   # open length at the end when a chunk starts at unit i
    after[n] = 0
    start_total = np.concatenate(([0], total[:-1]))
    ends = np.searchsorted(total, start_total + limit, side="left")
    for i in range(n - 1, -1, -1):
        after[i] = total[-1] - start_total[i] if ends[i] >= n else after[ends[i] + 1]
    carries = np.arange(limit)
    first = np.searchsorted(total, limit - carries, side="left")
    return np.where(first >= n, carries + total[-1], after[np.minimum(first + 1, n)])


def carry_steps(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What :func:`carry_map` says, without a value for every open length: the sums of lengths up to the first that fills a
    chunk on its own, the open length after the block when a chunk is closed there, and the sum of all."""
    total = np.cumsum(lengths)
    n = min(len(lengths), int(np.searchsorted(total, limit, side="left")) + 1)
    ends = np.searchsorted(total, total + limit, side="left")
    after = np.zeros(len(lengths), dtype=np.int64)   # open length at the end when a chunk is closed by unit i
    for i in range(len(lengths) - 2, -1, -1):
        after[i] = after[ends[i]] if ends[i] < len(lengths) else total[-1] - total[i]
    return total[:n], after[:n], int(total[-1])


def carry_after(upto: np.ndarray, after: np.ndarray, total: int, limit: int, carry: int) -> int:
    """Open length after a block (:func:`carry_steps`) that begins with ``carry`` open."""
    at = int(np.searchsorted(upto, limit - carry, side="left"))
    return int(after[at]) if at < len(upto) else carry + total


def _folded(units: Column, limit: int) -> Column:
    """Texts of the chunks of one section."""
    def step(acc, u):
        start_new = acc["open"] >= limit
        last = F.element_at(acc["texts"], -1)
        texts = F.when(F.size(acc["texts"]) == 0, F.array(u["piece"])).when(
            start_new, F.concat(acc["texts"], F.array(u["piece"]))).otherwise(
            F.concat(F.slice(acc["texts"], F.lit(1), F.size(acc["texts"]) - 1),
                     F.array(F.concat(last, F.lit("\n"), u["piece"]))))
        size = F.when(start_new, u["piece_len"]).otherwise(acc["open"] + u["piece_len"])
        return F.struct(size.alias("open"), texts.alias("texts"))

    zero = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("texts"))
    return F.aggregate(units, zero, step, lambda acc: acc["texts"])


def _sections(pieces: DataFrame, limit: int, short: int) -> DataFrame:
    """One row per section and page block: ``texts``, its chunks, of a section that ends in its block after at most ``short``
    units, and ``units`` of all others. Rows of a block are together already, so nothing moves."""
    grouped = pieces.groupBy("doc_id", "_pages", "section").agg(
        F.array_sort(F.collect_list(F.struct("unit_no", "piece", "piece_len", "page"))).alias("units"),
        F.max("chapter").alias("chapter"), F.max("subheading").alias("subheading"),
        F.min(F.coalesce("section_page", "page")).alias("page_physical"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    block = W.partitionBy("doc_id", "_pages")
    # The first and the last section of a block may go on in the blocks beside it.
    whole = ((F.col("section") > F.min("section").over(block)) | (F.col("_pages") <= F.col("_first"))) & (
        (F.col("section") < F.max("section").over(block)) | (F.col("_pages") >= F.col("_last")))
    folds = whole & (F.size("units") <= short)
    return grouped.withColumn("_folds", folds).select(
        "doc_id", "section", "chapter", "subheading", "page_physical",
        F.when(F.col("_folds"), _folded(F.col("units"), limit)).alias("texts"),
        F.when(~F.col("_folds"), F.col("units")).alias("units"))


def _block_steps(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            steps = [carry_steps(np.asarray(x, dtype=np.int64), limit) for x in pdf["lengths"]]
            yield pdf[["doc_id", "section", "blk"]].assign(
                upto=[s[0].tolist() for s in steps], after=[s[1].tolist() for s in steps], total=[s[2] for s in steps])
    return run


def _scan_carries(limit: int):
    """Blocks arrive in order; only one number per section is kept between them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, carry = None, 0
        for pdf in batches:
            carries = []
            for doc, section, upto, after, total in zip(pdf["doc_id"], pdf["section"], pdf["upto"], pdf["after"], pdf["total"]):
                if (doc, section) != here:
                    here, carry = (doc, section), 0
                carries.append(carry)
                carry = carry_after(upto, after, total, limit, carry)
            yield pdf[["doc_id", "section", "blk"]].assign(carry=carries)
    return run


def _fill_blocks(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            filled = [fill_starts(np.asarray(x, dtype=np.int64), limit, int(c)) for x, c in zip(pdf["lengths"], pdf["carry"])]
            # Every piece has a length, so nothing is left open only when the last chunk was closed.
            yield pdf[["doc_id", "section", "blk"]].assign(
                closed=[c.tolist() for c, _ in filled], total=[int(c[-1]) + (1 if left == 0 else 0) for c, left in filled],
                parts=[int(c[-1]) + 1 for c, _ in filled])
    return run


def _fill_long(sections: DataFrame, limit: int, pages: int = PAGES_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Sections of any size, block by block: their chunks, and ``n`` chunks per section and page.

    The fill is a state machine whose state is the open length, so a block acts on it as a table
    ``open length before -> after``. The tables of all blocks are made in parallel, chained in
    order (one number of state), and then every block is filled on its own. Only lengths go
    through Python, many blocks at a time.
    """
    meta, key = ["doc_id", "section"], ["doc_id", "section", "blk"]
    p = sections.select(*meta, F.explode("units").alias("u")).select(*meta, "u.*").withColumn("blk", page_block(pages))
    lengths = p.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("unit_no", "piece_len"))), lambda u: u["piece_len"]).alias("lengths"))
    steps = lengths.mapInPandas(
        _block_steps(limit), "doc_id string, section long, blk long, upto array<long>, after array<long>, total long")
    carries = steps.repartition(*meta).sortWithinPartitions(*key).mapInPandas(
        _scan_carries(limit), "doc_id string, section long, blk long, carry long")
    filled = materialise(lengths.join(carries, key).mapInPandas(
        _fill_blocks(limit), "doc_id string, section long, blk long, closed array<long>, total long, parts long"))
    # A block's chunk numbers start where the one before stopped; a chunk left open runs on.
    offsets = running(filled.select(*key, "total", "parts"), meta, "blk", sums={"upto": F.col("total")}, size=BLOCKS_PER_SCAN).select(
        *key, (F.col("upto") - F.col("total")).alias("offset"), "parts")
    about = sections.groupBy(*meta).agg(
        F.max("chapter").alias("chapter"), F.max("subheading").alias("subheading"), F.min("page_physical").alias("page_physical"))
    numbers = filled.select(*key, "closed").join(offsets.drop("parts"), key).join(about, meta)
    blocks = p.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("unit_no", "piece", "piece_len"))).alias("units"))
    filed = blocks.join(numbers, key).select(
        *meta, "chapter", "subheading", "page_physical", "offset", F.explode(F.arrays_zip("units", "closed")).alias("u"))
    parts = filed.groupBy(*meta, (F.col("u.closed") + F.col("offset")).alias("part_no")).agg(
        F.max("chapter").alias("chapter"), F.max("subheading").alias("subheading"), F.min("page_physical").alias("page_physical"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u.units.unit_no", "u.units.piece"))),
                                 lambda x: x["piece"]), "\n").alias("text"))
    counts = offsets.groupBy(*meta).agg(F.max(F.col("offset") + F.col("parts")).alias("n")).join(about, meta)
    return parts.select(*meta, "chapter", "subheading", "page_physical", "part_no", "text"), counts.select("doc_id", "page_physical", "n")


def chunk_accumulate(units: DataFrame, limit: int = MAX_CHARS, short: int = SHORT_SECTION,
                     pages: int = PAGES_PER_BLOCK) -> DataFrame:
    """Fill chunks greedily within each section until they reach ``limit`` characters.

    Result: ``doc_id, chunk_no, chapter, subheading, page_physical, text`` with ``chunk_no`` in
    page order and, within a page, in reading order. Sections of more than ``short`` units, and those that may reach
    over the edge of a page block, take the block-wise way; all others are folded where they are.
    """
    sections = materialise(_sections(_pieces(section_ids(units)), limit, short))
    folded, others = sections.where("texts is not null"), sections.where("texts is null")
    parts = folded.select("doc_id", "section", "chapter", "subheading", "page_physical",
                          F.posexplode("texts").alias("part_no", "text")).withColumn("part_no", F.col("part_no").cast("long"))
    census = folded.select("doc_id", "page_physical", F.size("texts").cast("long").alias("n"))
    if not others.isEmpty():
        filled, counts = _fill_long(others, limit, pages)
        parts, census = parts.unionByName(filled), census.unionByName(counts)
    return chunk_page_sort(parts, census)


def chunk_page_sort(parts: DataFrame, census: DataFrame | None = None) -> DataFrame:
    """Stable order by page (a missing page counts as 0), numbered without gaps."""
    page = F.coalesce("page_physical", F.lit(0))
    return dense_number(parts, DOC, F.floor(page / PAGES_PER_BLOCK).cast("long"),
                        [page, F.col("section"), F.col("part_no")], "chunk_no", census=census).select(
        "doc_id", "chunk_no", "chapter", "subheading", "page_physical", "text")


def chunk_overlap(chunks: DataFrame, seps: Sequence[str] = ("\n",), chars: int = OVERLAP,
                  keys: Sequence[str] = DOC, size: int = BLOCK) -> DataFrame:
    """Put the end of the previous chunk before and the start of the next one behind each text.

    Several separators mean several passes, each over the texts the one before made. As every
    block comes with one more edge row per pass, all passes share one shuffle and one sort.
    """
    near, w = with_halo(chunks, keys, "chunk_no", size, halo=len(seps))
    t = F.col("text")
    for sep in seps:
        near = near.withColumn("text", F.concat(
            F.coalesce(F.concat(F.lag(F.right(t, F.lit(chars))).over(w), F.lit(sep)), F.lit("")), t,
            F.coalesce(F.concat(F.lit(sep), F.lead(F.left(t, F.lit(chars))).over(w)), F.lit(""))))
    return drop_halo(near)


def overlap_sizes(chunks: DataFrame, chars: int = OVERLAP, keys: Sequence[str] = DOC) -> DataFrame:
    """Sizes of the overlap asked for on either side: 0 at the ends of a document."""
    one = F.lit(1)
    near = neighbours(chunks, keys, "chunk_no", lags={"_pre": one}, leads={"_post": one})
    return near.withColumn("overlap", F.struct(
        F.when(F.col("_pre").isNull(), 0).otherwise(chars).alias("pre"),
        F.when(F.col("_post").isNull(), 0).otherwise(chars).alias("post"))).drop("_pre", "_post")


def chunk_min_length(text, min_chars: int = MIN_CHARS):
    """A usable chunk text has at least ``min_chars`` characters after trimming."""
    return F.coalesce(F.length(strip(text)) >= min_chars, F.lit(False))


def chunk_id(doc="doc_id", no="chunk_no"):
    return F.sha2(F.concat_ws(":", doc, F.col(no).cast("string")), 256)


def next_links(chunks: DataFrame, block: int = 4096) -> DataFrame:
    """Pairs of consecutive chunk ids of a document; a chunk never links to itself."""
    seq = dense_number(chunks.select("doc_id", "chunk_no", "chunk_id"), DOC,
                       block_of("chunk_no", block), [F.col("chunk_no")], "_seq")
    near = neighbours(seq, DOC, "_seq", lags={"src": F.col("chunk_id")})
    return near.where("src is not null and src <> chunk_id").select(
        "doc_id", "src", F.col("chunk_id").alias("dst"))
