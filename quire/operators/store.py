"""Keyed tables: registry and vector upserts, deletes, exports, ingestion reports."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.session import checkpoint_dir, materialise
from quire.sources.files import allowed_name

RANGE_ROWS = 1 << 16     # rows of a listing that are sorted together


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest row per key. An aggregate, so map tasks combine and a hot key costs one row each."""
    rows = existing.unionByName(updates)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return latest.select(*keys, "_r.*").select(*rows.columns)


def lookup(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def delete(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_report(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per requested id: was there a row to delete."""
    return exists_flag(ids.select(key).distinct(), table, key, "deleted")


def exists_flag(ids: DataFrame, table: DataFrame, key: str = "doc_id", name: str = "found") -> DataFrame:
    known = table.select(key).distinct().withColumn(name, F.lit(True))
    return ids.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def new_rows(table: DataFrame, exported: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key was not exported before."""
    return table.join(exported.select(key).distinct(), key, "left_anti")


def merge_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], version: str,
                buckets: int = 64, bucket_key: str | None = None) -> None:
    """Upsert into a parquet table split by a key hash; only buckets with updates are rewritten."""
    updates = updates.withColumn("bucket", F.pmod(F.xxhash64(bucket_key or keys[0]), F.lit(buckets)).cast("int"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    merged = updates
    if exists:
        old = spark.read.parquet(path)
        touched = old.join(F.broadcast(updates.select("bucket").distinct()), "bucket", "left_semi")
        merged = upsert(touched.select(*updates.columns), updates, keys, version)
    else:
        merged = upsert(updates.limit(0), updates, keys, version)
    # Written aside first: a table cannot be overwritten while it is read.
    merged = materialise(merged) if exists else merged
    (merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def distinct_ids(raw: DataFrame, value: str = "value", position: str = "pos") -> DataFrame:
    """Requested ids: trimmed, blanks dropped, first position of each kept."""
    return raw.select(strip(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("doc_id"), position) \
        .where("doc_id <> ''").groupBy("doc_id").agg(F.min(position).alias(position))


def bulk_delete(raw_ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Outcome per requested id."""
    found = exists_flag(distinct_ids(raw_ids), registry)
    return found.select("doc_id", "pos", F.when(F.col("found"), "deleted").otherwise("document not found")
                        .alias("outcome"))


def batch_status(ok: Column, failed: Column) -> Column:
    return F.when((ok > 0) & (failed == 0), "success").when(ok > 0, "partial").otherwise("failed")


def bulk_delete_summary(outcome: DataFrame) -> DataFrame:
    c = outcome.agg(
        F.count(F.lit(1)).alias("requested_count"),
        F.count_if(F.col("outcome") == "deleted").alias("deleted_count"),
        F.count_if(F.col("outcome") != "deleted").alias("failed_count"))
    return c.withColumn("status", batch_status(F.col("deleted_count"), F.col("failed_count")))


def cascade_delete(outcome: DataFrame, registry: DataFrame, vectors: DataFrame, nodes: DataFrame,
                   edges: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table once the found documents are gone."""
    from quire.operators.graph import graph_delete
    gone = outcome.where(F.col("outcome") == "deleted").select("doc_id")
    left_nodes, left_edges = graph_delete(nodes, edges, gone)
    return {"registry": delete(registry, gone), "vectors": delete(vectors, gone),
            "nodes": left_nodes, "edges": left_edges}


def ingestion_report(files: DataFrame) -> DataFrame:
    """One row per input file: 1 when it went through, 0 when it carries an error."""
    return files.select("file_name", F.when(F.col("error").isNull(), 1).otherwise(0).alias("status"))


def classify_uploads(files: DataFrame) -> DataFrame:
    name = F.coalesce("file_name", F.lit(""))
    return files.withColumn("outcome", F.when(name == "", "Invalid filename")
                            .when(~allowed_name(name), "Only PDF files are supported")
                            .when(F.col("error").isNotNull(), F.col("error")).otherwise("ok"))


def ingest_batch_summary(files: DataFrame, batch: str = "batch") -> DataFrame:
    c = classify_uploads(files).groupBy(batch).agg(
        F.count(F.lit(1)).alias("uploaded_count"),
        F.count_if(F.col("outcome") == "ok").alias("ingested_count"),
        F.count_if(F.col("outcome") != "ok").alias("failed_count"))
    return c.withColumn("status", batch_status(F.col("ingested_count"), F.col("failed_count")))


def document_search(table: DataFrame, text: str, columns: Sequence[str] = ("title", "source_path", "doc_id")) -> DataFrame:
    """Case-insensitive substring over several columns; a blank search keeps everything."""
    q = text.strip().lower()
    if not q:
        return table
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return table.where(test)


@dataclass(frozen=True)
class Listing:
    """A table stored in ranges of an order, and how many rows each range has."""
    rows: DataFrame
    order: Sequence[Column]
    counts: Sequence[int]

    def page(self, page: int, size: int = 10) -> DataFrame:
        """One page, with the page number clamped to the last page. The counts tell which ranges hold it; only
        these are read and sorted, for the first page as for the last."""
        total = sum(self.counts)
        pages = max(1, -(-total // size))
        page = max(1, min(page, pages))
        start, ends = (page - 1) * size, list(accumulate(self.counts))
        first = bisect_right(ends, start)
        last = bisect_left(ends, min(start + size, total)) if total else 0
        before = ends[first - 1] if first else 0
        held = self.rows.where(F.col("_range").between(first, last)).drop("_range")
        return held.orderBy(*self.order).offset(start - before).limit(size).withColumns(
            {"page": F.lit(page), "total_pages": F.lit(pages)})


def listing(table: DataFrame, order: Sequence[Column], range_rows: int = RANGE_ROWS) -> Listing:
    """The table cut into ranges of about ``range_rows`` rows in its order, once for all its pages. Only the number of
    rows of each range comes to the driver."""
    spark = table.sparkSession
    ranges = max(1, -(-table.count() // range_rows))
    folder = f"{checkpoint_dir(spark)}/quire-listing-{uuid.uuid4().hex}"
    cut = table.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    cut.write.partitionBy("_range").parquet(folder)
    stored = spark.read.schema(cut.schema).parquet(folder)
    found = dict(stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    return Listing(stored, order, [found.get(i, 0) for i in range(ranges)])


def paginate(table: DataFrame, order: Sequence[Column], page: int, size: int = 10, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One page of an ordered listing; who needs several keeps the :func:`listing`."""
    return listing(table, order, range_rows).page(page, size)
