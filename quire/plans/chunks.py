"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunking as C
from quire.operators.layout import styled_units


SEPARATORS = ("\n", " ")


def chunk_documents(spans: DataFrame, passes: int = 1, max_pages: int = 20) -> DataFrame:
    """Spans to identified chunks.

    ``passes=1`` adds the newline overlap only. ``passes=2`` overlaps the overlapped text once
    more with a space, which is what a two-stage ingestion ends up with.
    """
    chunks = C.chunk_overlap(C.chunk_accumulate(styled_units(spans, max_pages)), SEPARATORS[:passes])
    return chunks.where(C.chunk_min_length(F.col("text"))).select(
        "doc_id", "chunk_no", C.chunk_id().alias("chunk_id"), "chapter", "subheading",
        F.lit(None).cast("string").alias("page_label"), "page_physical", "text")
