"""Stateless and windowed streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import content_id
from quire.functions.toc import page_type
from quire.operators.search import BUCKETS, doc_bucket
from quire.plans.chunks import chunk_documents
from quire.session import materialise
from quire.sources.versions import VersionedTables
from quire.streaming.run import for_each_batch
from quire.streaming.windows import sliding_counts


def stream_toc_hits(pages: DataFrame) -> DataFrame:
    """Contents pages as pages arrive: a projection without state."""
    return pages.where(F.col("page_index") < 15).select(
        "doc_id", "page_index", page_type(F.col("page_index"), F.col("text")).alias("toc_type")).where("toc_type is not null")


def stream_event_dedup(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as copies come within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_rate_limit(events: DataFrame, length: str = "1 hour", slide: str = "5 minutes",
                      delay: str = "10 minutes") -> DataFrame:
    """Events per user in sliding windows; events later than the delay are dropped from windows that are closed."""
    return sliding_counts(events, length, slide, delay)


def stream_ingest(documents: DataFrame, to_spans, path: str, progress: str | None = None, buckets: int = BUCKETS) -> VersionedTables:
    """Document rows (``text``) to the table ``chunks`` of a versioned store at ``path``, keyed by content: a copy or a
    replayed batch makes the same rows again and changes nothing.

    A batch is one version: readers see all of it or nothing. Only buckets with new documents are written, and
    Spark splits one that receives much. ``buckets`` counts when the store is new.
    """
    store = VersionedTables(documents.sparkSession, path)

    def handle(batch: DataFrame, _batch_id: int) -> None:
        at = store.snapshot()
        bucket = doc_bucket(at.buckets or buckets)
        texts = batch.select(content_id(F.col("text")).alias("doc_id"), "text").groupBy("doc_id").agg(
            F.any_value("text").alias("text"))
        if at.parts:
            texts = texts.join(store.read("documents", at).select("doc_id"), "doc_id", "left_anti")
        texts = materialise(texts)
        new = {"documents": texts.select("doc_id", bucket.alias("bucket")),
               "chunks": chunk_documents(to_spans(texts)).withColumn("bucket", bucket)}
        changed = sorted(r[0] for r in new["documents"].select("bucket").distinct().collect())  # at most ``buckets``
        if changed:
            old = {t: store.read(t, at, changed).select(*df.columns) for t, df in new.items()} if at.parts else {}
            store.commit(at, changed, {t: df.unionByName(old[t]) if t in old else df for t, df in new.items()},
                         buckets=at.buckets or buckets)
    for_each_batch(documents, handle, progress=progress)
    return store
