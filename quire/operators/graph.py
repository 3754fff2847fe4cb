"""The document graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordered import first_rows
from quire.session import materialise

MAX_EXPANDED = 50
SEEDS = 5
HOP_SCORE = 0.7


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", "chunk_id",
        F.coalesce("chapter", F.lit("Unknown")).alias("chapter"),
        F.coalesce("subheading", F.lit("Unknown")).alias("subheading"),
        F.coalesce("emotion", F.lit("Neutral")).alias("emotion"))


def _key(name: str) -> Column:
    return F.concat_ws("|", "doc_id", name)


def graph_build_nodes(chunks: DataFrame) -> DataFrame:
    """Nodes of five labels, each key once: ``label, key, doc_id, name``."""
    def node(label, key, doc, name):
        return F.struct(F.lit(label).alias("label"), key.alias("key"), doc.alias("doc_id"), name.alias("name"))
    doc, none = F.col("doc_id"), F.lit(None).cast("string")
    return _named(chunks).select(F.inline(F.array(
        node("Document", doc, doc, none),
        node("Chapter", _key("chapter"), doc, F.col("chapter")),
        node("Subheading", _key("subheading"), doc, F.col("subheading")),
        node("Chunk", F.col("chunk_id"), doc, none),
        node("Emotion", F.col("emotion"), none, F.col("emotion")),
    ))).distinct()


def graph_build_edges(chunks: DataFrame, with_document: bool = False) -> DataFrame:
    """Hierarchy and emotion relations, each once: ``rel, src, dst``, and on request the ``doc_id`` they belong to."""
    def edge(rel, src, dst):
        return F.struct(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))
    return _named(chunks).select(*["doc_id"] * with_document, F.inline(F.array(
        edge("HAS_CHAPTER", F.col("doc_id"), _key("chapter")),
        edge("HAS_SUBHEADING", _key("chapter"), _key("subheading")),
        edge("HAS_CHUNK", _key("subheading"), F.col("chunk_id")),
        edge("HAS_EMOTION", F.col("chunk_id"), F.col("emotion")),
    ))).distinct()


def graph_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take out every node of the documents and every edge that touches one.

    Nodes without a document, like the emotions, are hubs: a third of all edges may end in one. They are few and
    never go, so an edge that ends in one is dealt out by its other end, where it meets nothing. The edges are read once.
    """
    ids = ids.select("doc_id").distinct()
    gone = materialise(nodes.join(ids, "doc_id", "left_semi").select("key").distinct())
    kept_nodes = nodes.join(ids, "doc_id", "left_anti").select(*nodes.columns)
    hubs = materialise(nodes.where("doc_id is null").select("key").distinct())
    owned = gone.select(F.col("key").alias("_key"), F.lit(False).alias("_hub"))

    def outside(df: DataFrame, end: str, other: str) -> DataFrame:
        shared = hubs.select(F.col("key").alias(end), F.lit(True).alias("_shared"))
        placed = df.join(shared, end, "left").withColumn("_hub", F.col("_shared").isNotNull())
        placed = placed.withColumn("_key", F.when(F.col("_hub"), F.col(other)).otherwise(F.col(end)))
        return placed.join(owned, ["_key", "_hub"], "left_anti").select(*df.columns)
    return kept_nodes, outside(outside(edges, "src", "dst"), "dst", "src").select(*edges.columns)


def link_endpoint_check(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links between two different chunks that both exist."""
    known = chunks.select("chunk_id").distinct()
    return (
        links.where(F.col("src") != F.col("dst"))
        .join(known.withColumnRenamed("chunk_id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("chunk_id", "dst"), "dst", "left_semi").select(*links.columns)
    )


def emotion_left_join(chunks: DataFrame, edges: DataFrame, emotion: str | None = None) -> DataFrame:
    """Chunks with their emotion, if any; an emotion filter is a real filter."""
    e = edges.where(F.col("rel") == "HAS_EMOTION").select(
        F.col("src").alias("chunk_id"), F.col("dst").alias("emotion"))
    out = chunks.join(e, "chunk_id", "left")
    return out if emotion is None else out.where(F.col("emotion") == emotion)


def both_ways(links: DataFrame) -> DataFrame:
    """Chunk links as undirected steps ``a, b``, with the document where the links have one."""
    doc = [F.col("doc_id")] if "doc_id" in links.columns else []
    return links.select(F.inline(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), *doc),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), *doc))))


def two_hops(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks one or two links away from each seed, the seed itself left out.

    ``seeds`` has ``chunk_id`` next to grouping columns; the result adds ``near_id`` and, where the
    links have one, ``near_doc``. A path may not use a link twice, which leaving out the seed
    already ensures. Seeds and first hops are small next to the links: written aside, their true
    size lets the link table be scanned in place instead of shuffled.
    """
    steps = both_ways(links).withColumnsRenamed({"doc_id": "near_doc"})
    doc = ["near_doc"] if "near_doc" in steps.columns else []
    group = list(seeds.columns)
    one = materialise(seeds.join(steps, seeds["chunk_id"] == steps["a"]).select(*group, F.col("b").alias("near_id"), *doc))
    again = steps.withColumnsRenamed({"a": "_a", "b": "_b"})
    two = one.drop("near_doc").join(again, F.col("near_id") == F.col("_a")).select(*group, F.col("_b").alias("near_id"), *doc)
    return one.unionByName(two).where(F.col("near_id") != F.col("chunk_id")).distinct()


def _carried(chunks: DataFrame) -> list[str]:
    """Chunk columns that travel with a hit; ids alone where the text is fetched later."""
    return [c for c in ("doc_id", "chunk_id", "text") if c in chunks.columns]


def _reached(near: DataFrame, chunks: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Hits by ``chunk_id`` with their document: from the chunk table, or from the links alone."""
    if chunks is None:
        return near.withColumnRenamed("near_doc", "doc_id"), ["doc_id", "chunk_id"]
    cols = _carried(chunks)
    return near.drop("near_doc").join(chunks.select(*cols), "chunk_id"), cols


def multihop_expand(seeds: DataFrame, links: DataFrame, chunks: DataFrame | None = None, by: str = "query_id",
                    rank: str = "rank", n_seeds: int = SEEDS, limit: int = MAX_EXPANDED,
                    doc_filter: DataFrame | None = None) -> DataFrame:
    """Neighbours of each query's first seeds: distinct, at most ``limit`` per query (in id order),
    all with one constant score. ``doc_filter`` (``query_id, doc_id``) keeps one document."""
    start = seeds.where(F.col(rank) <= n_seeds).select(by, "chunk_id")
    near = two_hops(start, links).drop("chunk_id").withColumnRenamed("near_id", "chunk_id").distinct()
    out, cols = _reached(near, chunks)
    if doc_filter is not None:
        out = out.join(doc_filter, [by, "doc_id"], "left_semi")
    out = first_rows(out, [by], [F.col("chunk_id")], limit)
    return out.select(by, *cols, F.lit(HOP_SCORE).alias("score"), F.lit("graph_multihop").alias("source"))


def expand_chunk_context(hits: DataFrame, links: DataFrame, chunks: DataFrame | None = None, by: str = "query_id",
                         limit: int = MAX_EXPANDED) -> DataFrame:
    """Neighbours of each hit inside the hit's own document, at most ``limit`` per hit. Without a
    chunk table the hits bring their ``doc_id``."""
    if chunks is None:
        here = hits.select(by, "chunk_id", F.col("doc_id").alias("_doc")).distinct()
    else:
        here = hits.select(by, "chunk_id").distinct().join(
            chunks.select("chunk_id", F.col("doc_id").alias("_doc")), "chunk_id").select(by, "chunk_id", "_doc")
    near = two_hops(here, links).withColumnRenamed("chunk_id", "seed_id").withColumnRenamed("near_id", "chunk_id")
    out, cols = _reached(near, chunks)
    out = first_rows(out.where("doc_id = _doc"), [by, "seed_id"], [F.col("chunk_id")], limit)
    return out.select(by, *cols, F.lit(HOP_SCORE).alias("score"),
                      F.lit("graph_multihop").alias("source")).dropDuplicates([by, "doc_id", "chunk_id"])


def structure_enrich(results: DataFrame, structure: DataFrame) -> DataFrame:
    """Fill a missing chapter or subheading from the hierarchy (``chunk_id, chapter, subheading``)."""
    s = structure.select("chunk_id", F.col("chapter").alias("_chapter"), F.col("subheading").alias("_sub"))
    out = results.join(s, "chunk_id", "left")
    return out.withColumns({"chapter": F.coalesce("chapter", "_chapter"),
                            "subheading": F.coalesce("subheading", "_sub")}).drop("_chapter", "_sub")


def structure_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunk to subheading to chapter, read off the edges; the smallest name where several lead up."""
    up = edges.where(F.col("rel") == "HAS_CHUNK").select(F.col("dst").alias("chunk_id"), F.col("src").alias("sub_key"))
    above = edges.where(F.col("rel") == "HAS_SUBHEADING").select(F.col("dst").alias("sub_key"), F.col("src").alias("chap_key"))
    names = nodes.select("label", "key", "name")
    sub = names.where(F.col("label") == "Subheading").select(F.col("key").alias("sub_key"), F.col("name").alias("subheading"))
    chap = names.where(F.col("label") == "Chapter").select(F.col("key").alias("chap_key"), F.col("name").alias("chapter"))
    return up.join(sub, "sub_key").join(above, "sub_key").join(chap, "chap_key").groupBy("chunk_id").agg(
        F.min("chapter").alias("chapter"), F.min("subheading").alias("subheading"))
