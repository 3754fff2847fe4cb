"""Candidate tables: validity, filters, deduplication, top-k, reranking, result statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.operators.ordered import first_rows

REQUIRED = ("chunk_id", "doc_id", "score", "source", "text")
RERANK_CHARS = 1024
MEDICAL_GATE, BOOK_GATE = 0.18, 0.05


def candidate_schema_filter(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows with every required field and a score that reads as a number."""
    out = df.withColumn("score", F.col("score").try_cast("double"))
    return out.dropna(how="any", subset=list(required))


def metadata_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """All of the equalities; a missing value matches nothing."""
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def min_score_filter(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score") >= least) if least > 0 else df


def best_per_key(df: DataFrame, by: Sequence[str] = ("query_id",), order: Sequence[Column] = ()) -> DataFrame:
    """One row per query and chunk: the highest score, the first on a tie; rows without ids go.

    Written as a rank-1 window: map tasks keep one row per key before the shuffle.
    """
    named = df.where((F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != ""))
    return first_rows(named, [*by, "doc_id", "chunk_id"], [F.col("score").desc_nulls_last(), *order])


def top_per_query(df: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score") -> DataFrame:
    return first_rows(df, by, [F.col(score).desc_nulls_last(), F.col("doc_id"), F.col("chunk_id")], k, rank="rank")


def score_topk(df: DataFrame, k: int = 15, by: Sequence[str] = ("query_id",), order: Sequence[Column] = ()) -> DataFrame:
    """Valid rows, best per chunk, best ``k`` per query."""
    return top_per_query(best_per_key(candidate_schema_filter(df), by, order), k, by)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that occur in the text: the native pair score."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, tokens(text))) / F.size(q), 6)).otherwise(0.0)


def rerank_topk(df: DataFrame, k: int = 15, by: Sequence[str] = ("query_id",),
                scorer: Callable[[Column, Column], Column] = overlap_score,
                max_chars: int = RERANK_CHARS) -> DataFrame:
    """Score (query, text) pairs, best ``k`` per query. Rows without text go; texts are cut for the
    model. Where a pair gets no score the row keeps its place in the order it came in."""
    c = df.where(F.coalesce("text", F.lit("")) != "").withColumn("text", F.substring("text", 1, max_chars))
    c = c.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    return first_rows(c, by, [F.col("rerank_score").desc_nulls_last(), F.col("score").desc_nulls_last(),
                              F.col("doc_id"), F.col("chunk_id")], k, rank="rank")


def rank_boost(df: DataFrame) -> DataFrame:
    """Add 0.5 where the query phrase occurs and 0.6 where the emotions agree; drop empty texts."""
    phrase = F.contains(F.lower("text"), F.lower("query"))
    same = F.coalesce(F.col("query_emotion") == F.col("emotion"), F.lit(False))
    return df.where(F.coalesce("text", F.lit("")) != "").withColumn(
        "score", F.col("score") + F.when(phrase, 0.5).otherwise(0.0) + F.when(same, 0.6).otherwise(0.0))


def rerank_gate(df: DataFrame, medical: float = MEDICAL_GATE, book: float = BOOK_GATE) -> DataFrame:
    """Per query: does its best rerank score reach the threshold of its intent."""
    limit = F.when(F.col("intent") == "medical", medical).otherwise(book)
    best = df.groupBy("query_id", "intent").agg(F.max(F.coalesce("rerank_score", F.lit(0.0))).alias("max_rerank_score"))
    return best.withColumn("passed", F.col("max_rerank_score") >= limit)


def has_valid_context(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id").agg(
        F.bool_or(F.length(F.coalesce("text", F.lit(""))) > 0).alias("has_context"))


def result_projection(df: DataFrame, preview: int = 360) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", "doc_id", "source", "score", "rerank_score", "text",
                     F.substring(F.coalesce("text", F.lit("")), 1, preview).alias("preview"))


def retrieval_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.countDistinct(F.when(F.col("doc_id") != "", F.col("doc_id"))).alias("unique_document_count"),
        F.bround(F.avg("score"), 6).alias("avg_score"), F.bround(F.max("score"), 6).alias("max_score"),
        F.bround(F.min("score"), 6).alias("min_score"))


def unify(*parts: DataFrame) -> DataFrame:
    """Candidates of several searches under one schema; ``leg`` keeps the order of the parts."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("leg", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
