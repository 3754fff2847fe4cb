"""Tables written between steps, row numbers without a global window, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.session import checkpoint_dir

NUMBER_BUCKETS = 4096


class Scratch:
    """Tables in the cluster's shared folder. They cut lineage, survive lost executors and keep
    column pruning; :meth:`drop` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # the id stays taken as long as the table is in use
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that do not clash with a column of ``df`` (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bucket_of(keys: list[Column], buckets: int = NUMBER_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_starts(counts: DataFrame, group: list[str], bucket: str, n: str, start: str) -> DataFrame:
    """Rows before each bucket. ``counts`` has one row per group and bucket, so it never grows
    beyond the number of groups times the number of buckets."""
    w = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(start, F.coalesce(F.sum(n).over(w), F.lit(0)))


def _links(edges: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the undirected links ``(a, b)`` by alternating stars.

    Every round links the neighbours of a node to its smallest neighbour, first the larger ones
    and then the smaller ones, until the links are stars around the smallest node. Minima are
    aggregates joined back, so that a node with very many links is pre-aggregated and its join
    partition can be split. Returns ``(node, root)`` for every node with a link; null ends are no
    links. Only a count and a checksum of each round reach the driver.
    """
    links = scratch.save(_links(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before = _state(links)
    while before[0]:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = links.select(F.col("b").alias("a"), F.col("a").alias("v"))
        large = _links(larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = scratch.save(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.save(_links(small.union(least.select("a", F.col("m").alias("b")))))
        scratch.drop(large)
        scratch.drop(links)
        links, after = now, _state(now)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
