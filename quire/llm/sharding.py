"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.tables import Scratch, bucket_of, bucket_starts

ROUNDS = 6
COPIES_AT_ONCE = 10_000


def halves(n: int) -> tuple[int, int]:
    """Radices ``a, b`` with ``n <= a * b < n + a``: the smallest nearly square domain."""
    a = max(1, math.isqrt(n))
    a += a * a < n
    return a, max(1, -(-n // a))


def whole(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _round(x: Column, seed: int, step: int, radix: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed), F.lit(step)), F.lit(radix))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass over the domain ``a * b``: each round adds a hash of one half to the other, modulo
    that half's radix, which can be undone, so the pass is a permutation of the domain."""
    a, b = halves(n)

    def step(r: int):
        def on(pair: Column) -> Column:
            left, right = pair["l"], pair["r"]
            if r % 2:
                right = F.pmod(right + _round(left, seed, r, b), F.lit(b))
            else:
                left = F.pmod(left + _round(right, seed, r, a), F.lit(a))
            return F.struct(left.alias("l"), right.alias("r"))
        return on

    x = x.cast("long")
    pair = F.array(F.struct(whole(x, b).alias("l"), F.pmod(x, F.lit(b)).alias("r")))
    for r in range(ROUNDS):
        pair = F.transform(pair, step(r))
    return F.transform(pair, lambda p: p["l"] * F.lit(b) + p["r"])[0]


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """Permutation of ``0 .. n-1``. Where a pass lands at ``n`` or beyond it goes on from there
    (cycle walking). A walk meets every value beyond ``n`` at most once, so ``a * b - n`` further
    passes always end it; only the few rows that land there walk at all."""
    a, b = halves(n)
    once = F.transform(F.array(feistel(x, n, seed)), lambda y: y if a * b == n else F.when(y < n, y).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), y,
                    lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, seed)))))
    return once[0]


def unpermute(y: int, n: int, seed: int = 0, spark=None) -> int:
    """The row number that :func:`permute` sends to ``y``: its cycle is followed until it closes."""
    value = y
    while True:
        nxt = spark.range(1).select(permute(F.lit(value).cast("long"), n, seed)).first()[0]
        if nxt == y:
            return value
        value = nxt


def number_rows(docs: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0.. without a gap, one row per input row with ``keys`` only.

    Rows with equal keys are counted before the shuffle and take a run of numbers, so that a key
    that holds a third of all rows is one row until it is spread again. Numbers depend on the
    keys alone, not on files or partitions. Nulls are keys like any other.
    """
    each = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = Scratch(docs.sparkSession).save(each.withColumn("_b", bucket_of([F.col(k) for k in keys])))
    per = each.groupBy("_b").agg(F.sum("_n").alias("_rows"))
    starts = bucket_starts(per, [], "_b", "_rows", "_start")
    total = per.agg(F.sum("_rows")).first()[0] or 0
    within = W.partitionBy("_b").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    runs = each.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(
        starts.select("_b", "_start"), "_b").withColumn("_first", F.col("_start") + F.col("_before"))
    blocks = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), whole(F.col("_n") - 1, COPIES_AT_ONCE))))
    last = F.least(F.col("_n"), (F.col("_k") + 1) * COPIES_AT_ONCE) - 1
    rows = blocks.withColumn(number, F.explode(F.sequence(
        F.col("_first") + F.col("_k") * COPIES_AT_ONCE, F.col("_first") + last)))
    return rows.select(*keys, F.col(number).cast("long").alias(number)), int(total)


def shard_rows(docs: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``keys`` with ``row_number, place, shard, slot``: place is the permuted row number, shard and
    slot are its remainder and quotient by the number of shards.

    So any row's shard and slot follow from its number alone, shards differ by one row at most,
    and slots have no gap. Nulls, empty texts and repeated rows are rows like others; an empty
    table gives an empty one. Other columns of ``docs`` are left behind; join on the keys.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows, n = number_rows(docs, keys)
    rows = rows.withColumn("place", permute(F.col("row_number"), max(n, 1), seed))
    return rows.withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"),
                             "slot": whole(F.col("place"), shards)})


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Law ``rows`` over ``documents``: one row per document with its size (UTF-8 bytes plus 8), the
    checksum of its text (0 for null), shard and slot. A null ``doc_id`` or text is a value."""
    text = F.col("text")
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"))
    out = shard_rows(slim, slim.columns, shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
