"""Ranked retrieval for a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.emotion import NEUTRAL, emotion_of, prefix
from quire.functions.vectors import text_embed
from quire.operators import candidates as K
from quire.operators import graph as G
from quire.operators import search as S
from quire.operators.chunking import next_links
from quire.operators.nearest import knn_join
from quire.operators.ordered import first_rows
from quire.operators.search import doc_bucket
from quire.session import materialise

CONTEXT_SEEDS = 10
KEY = ["doc_id", "chunk_id"]
META = ["chapter", "subheading", "page_label", "page_physical"]


@dataclass(frozen=True)
class Corpus:
    """The tables an ingestion leaves behind. A search without vectors, or without words, may do without those it never reads."""
    chunks: DataFrame      # doc_id, chunk_id, chunk_no, text, chapter, subheading, page_*, emotion
    vectors: DataFrame | None  # doc_id, chunk_id, embedding
    links: DataFrame | None    # doc_id, src, dst
    index: S.TextIndex | None
    buckets: int = S.BUCKETS  # splits of the stored tables

    def filtered(self, filters: Mapping[str, object] | None) -> "Corpus":
        """Keep matching chunks everywhere, before any ranking."""
        if not filters:
            return self
        kept = K.metadata_filter(self.chunks, filters)
        ids = kept.select("chunk_id")
        links = G.link_endpoint_check(self.links, kept)
        index = replace(self.index, within=ids)
        return replace(self, chunks=kept, vectors=self.vectors.join(ids, "chunk_id", "left_semi"), links=links, index=index)


def load_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The tables as :func:`quire.plans.ingest.write_ingested` left them."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")
    return Corpus(read("chunks"), read("vectors"), read("links"), S.read_index(spark, folder))


def build_vectors(chunks: DataFrame, embed: Callable[[Column], Column] = text_embed) -> DataFrame:
    return materialise(chunks.select("doc_id", "chunk_id", embed(F.col("text")).alias("embedding")))


def build_links(chunks: DataFrame) -> DataFrame:
    return materialise(next_links(chunks))


def build_text_index(chunks: DataFrame) -> S.TextIndex:
    return S.stored_index(S.build_index(chunks), chunks.sparkSession)


def build_corpus(chunks: DataFrame, embed: Callable[[Column], Column] = text_embed) -> Corpus:
    """Vectors, links and inverted index of a chunk table, written once."""
    return Corpus(chunks, build_vectors(chunks, embed), build_links(chunks), build_text_index(chunks))


def with_concepts(queries: DataFrame) -> DataFrame:
    """Queries with their terms and, unless neutral, their emotion."""
    emotion = emotion_of(prefix(F.col("query")))
    return queries.select("query_id", "query", S.query_concepts(F.col("query")).alias("concepts"),
                          F.nullif(emotion, F.lit(NEUTRAL)).alias("query_emotion"))


def vector_topk(queries: DataFrame, corpus: Corpus, k: int, embed: Callable[[Column], Column] = text_embed,
                min_score: float = 0.0, post_filter: Mapping[str, object] | None = None) -> DataFrame:
    """``query_id, doc_id, chunk_id, score, source, rank`` of the nearest chunks.

    ``min_score`` and ``post_filter`` (equalities on the chunk's columns) look at the ``k`` nearest only, so that fewer
    may be left; ranks are those of what is left. :meth:`Corpus.filtered` filters before the search instead.
    """
    q = queries.select("query_id", embed(F.col("query")).alias("embedding"))
    near = knn_join(q, corpus.vectors, k).select(
        "query_id", "doc_id", "chunk_id", "score", F.lit("vector").alias("source"), "rank")
    if min_score <= 0 and not post_filter:
        return near
    kept = K.min_score_filter(near, min_score)
    if post_filter:
        matching = K.metadata_filter(corpus.chunks, post_filter).select("chunk_id")
        kept = kept.join(matching, "chunk_id", "left_semi")
    return first_rows(kept.withColumnRenamed("rank", "_place"), ["query_id"], [F.col("_place")], k, rank="rank").drop(
        "_place").select(*near.columns)


def _same_emotion(hits: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the chunk's emotion and keep only agreeing ones where the query has an emotion."""
    e = chunks.select("chunk_id", "emotion")
    return hits.join(e, "chunk_id", "left").join(asked.select("query_id", "query_emotion"), "query_id").where(
        F.col("query_emotion").isNull() | (F.col("emotion") == F.col("query_emotion"))).drop("query_emotion")


def fulltext_query(asked: DataFrame) -> DataFrame:
    """Index terms of each query, with the query's emotion."""
    keys = asked.select("query_id", "query_emotion", F.explode(S.term_keys(F.col("concepts"))).alias("term"))
    return keys.withColumn("term", F.lower("term"))


def graph_primary(asked: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """Full-text hits, three times as many as asked for; keyword hits for queries without any."""
    found = materialise(S.bm25_search(fulltext_query(asked), corpus.index, 3 * k))
    missing = asked.where(F.size("concepts") > 0).join(found.select("query_id").distinct(), "query_id", "left_anti")
    if not missing.isEmpty():
        words = missing.select("query_id", F.explode("concepts").alias("term"))
        extra = _same_emotion(S.keyword_theta_join(words, corpus.chunks), asked, corpus.chunks)
        extra = first_rows(extra, ["query_id"], [F.col("chunk_id")], k, rank="rank")
        found = found.unionByName(extra, allowMissingColumns=True)
    raw = F.col("score")
    return found.select("query_id", "doc_id", "chunk_id", S.fulltext_score_scale(raw).alias("score"),
                        S.fulltext_source(raw).alias("source"), "emotion", "rank")


def graph_merge(asked: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """Primary hits and the neighbourhood of the first five, best score per chunk."""
    primary = materialise(graph_primary(asked, corpus, k))
    near = G.multihop_expand(primary, corpus.links)
    return K.best_per_key(K.unify(primary, near), order=[F.col("leg"), F.col("rank")])


def fetch(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """Texts and metadata of all hit chunks (``doc_id, chunk_id``), read in one scan of the chunk
    table. A stored table is split by document bucket; only buckets that hold a hit are read."""
    chunks, ids = corpus.chunks, hits.select("doc_id", "chunk_id").distinct()
    on = ["chunk_id"]
    if "bucket" in chunks.columns:
        ids, on = ids.withColumn("bucket", doc_bucket(corpus.buckets)), ["bucket", "chunk_id"]
    ids = materialise(ids.select(*on))
    return materialise(chunks.join(ids, on, "left_semi").select("chunk_id", "text", *META))


def _graph_ranked(found: DataFrame, asked: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    full = found.join(texts.select("chunk_id", "text"), "chunk_id").join(
        asked.select("query_id", "query", "query_emotion"), "query_id")
    boosted = K.rank_boost(full).drop("text", "query", "query_emotion", "leg", "rank")
    return K.top_per_query(boosted, k)


def graph_retrieve(queries: DataFrame, corpus: Corpus, k: int = 15) -> DataFrame:
    """Terms to full text, two hops, boosts, best ``k`` per query."""
    asked = materialise(with_concepts(queries))
    found = materialise(graph_merge(asked, corpus, k))
    return _graph_ranked(found, asked, fetch(found, corpus), k)


def hybrid_candidates(queries: DataFrame, corpus: Corpus, initial_k: int, embed: Callable[[Column], Column] = text_embed,
                      min_score: float = 0.0, post_filter: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vector hits, graph hits and the surroundings of the first vector hits, one row per chunk;
    and the texts of everything looked at."""
    asked = materialise(with_concepts(queries))
    vector = materialise(vector_topk(queries, corpus, initial_k, embed, min_score, post_filter))
    around = materialise(G.expand_chunk_context(vector.where(F.col("rank") <= CONTEXT_SEEDS), corpus.links))
    graph = materialise(graph_merge(asked, corpus, initial_k))
    texts = fetch(vector.select(*KEY).unionByName(around.select(*KEY)).unionByName(graph.select(*KEY)), corpus)
    legs = K.unify(vector, _graph_ranked(graph, asked, texts, initial_k), around)
    return K.best_per_key(legs, order=[F.col("leg"), F.col("rank")]).drop("leg", "rank"), texts


def retrieve(queries: DataFrame, corpus: Corpus, mode: str = "hybrid", top_k: int = 8, initial_k: int = 15,
             filters: Mapping[str, object] | None = None,
             scorer: Callable[[Column, Column], Column] = K.overlap_score,
             embed: Callable[[Column], Column] = text_embed, min_score: float = 0.0,
             post_filter: Mapping[str, object] | None = None) -> DataFrame:
    """Best ``top_k`` chunks per query after reranking. ``filters`` hold before any ranking, ``min_score`` and
    ``post_filter`` thin out what the vector search found; ``embed`` and ``scorer`` may be models."""
    if mode not in ("vector", "graph", "hybrid"):
        raise ValueError(f"mode must be vector, graph or hybrid, not {mode}")
    corpus = corpus.filtered(filters)
    if mode == "hybrid":
        hits, texts = hybrid_candidates(queries, corpus, initial_k, embed, min_score, post_filter)
    else:
        leg = vector_topk(queries, corpus, initial_k, embed, min_score, post_filter) if mode == "vector" else \
            graph_retrieve(queries, corpus, initial_k)
        hits = materialise(leg.drop("rank"))
        texts = fetch(hits, corpus)
    if "emotion" not in hits.columns:
        hits = hits.withColumn("emotion", F.lit(None).cast("string"))
    none = {"chapter": F.lit(None).cast("string"), "subheading": F.lit(None).cast("string")}
    full = G.structure_enrich(hits.withColumns(none), texts.select("chunk_id", "chapter", "subheading"))
    full = full.join(texts.drop("chapter", "subheading"), "chunk_id").join(queries, "query_id")
    return K.rerank_topk(full, top_k, scorer=scorer).select(
        "query_id", "rank", "doc_id", "chunk_id", "score", "rerank_score", "source", *META, "emotion", "text")
