"""Exact nearest neighbours for a table of queries over a table of chunk vectors.

No pair table is ever made and the chunks move once per pass. They are cut into blocks of bounded size in the
order of their distance to a pivot. A task holds one block as a matrix and lets the queries that need it
stream past. Distances to a few pivots bound what a block can offer a query: each query first searches its
most promising block, and then only the blocks that may beat the k-th score found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quire.operators.ordered import first_rows
from quire.session import materialise

PIVOTS = 6
PIVOT_SAMPLE = 256       # vectors that pivots are chosen from; any pivots give the same result
BLOCK_BYTES = 8 << 20    # vectors of a block
MOST_BLOCKS = 32         # small blocks grow with the table up to BLOCK_BYTES, or a query would meet ever more of them
MATRIX_BYTES = 16 << 20  # scores of a block and the queries that pass it at once
HIT = "query_id string, doc_id string, chunk_id string, distance double, score double"
PLACES = 6


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ c.T
    if metric == "ip":
        return dot
    qq, cc = (q * q).sum(1)[:, None], (c * c).sum(1)[None, :]
    if metric == "l2":
        return np.maximum(qq + cc - 2 * dot, 0.0)
    return 1 - dot / np.sqrt(np.maximum(qq * cc, 1e-300))


def scores(distance: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return 1 / (1 + distance)
    return distance if metric == "ip" else 1 - distance


def _best_of(qids: np.ndarray, q: np.ndarray, block: pd.DataFrame, c: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """Best ``k`` rows of a block for each query; the block is in the order that settles equal scores."""
    d = distances(q, c, metric)
    s = scores(d, metric)
    # Only what may be equal to the k-th score after rounding is rounded.
    least = np.partition(s, -k, axis=1)[:, [-k]] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
    r, at = np.nonzero(s >= least - 2 * 10.0 ** -PLACES)
    score = np.round(s[r, at], PLACES)
    order = np.lexsort((at, -score, r))
    r, at, score = r[order], at[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, at, score = r[first], at[first], score[first]
    return pd.DataFrame({
        "query_id": qids[r], "doc_id": block["doc_id"].to_numpy()[at], "chunk_id": block["chunk_id"].to_numpy()[at],
        "distance": np.round(d[r, at], PLACES) + 0.0, "score": score + 0.0})


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _in_space(x: np.ndarray, metric: str, reach: float, query: bool = False) -> np.ndarray:
    """Vectors whose Euclidean distance orders like the metric. Products become distances by one more
    component that gives all chunks the norm ``reach``."""
    if metric == "l2":
        return x
    norm = np.sqrt((x * x).sum(1))
    if metric == "ip":
        return np.column_stack((x, np.zeros(len(x)) if query else np.sqrt(np.maximum(reach * reach - norm * norm, 0))))
    return x / np.maximum(norm, 1e-150)[:, None]


def _most(lower: Column, q2: Column, metric: str, reach: float) -> Column:
    """The highest score at a Euclidean distance of ``lower`` or more."""
    square = lower * lower
    if metric == "l2":
        return 1 / (1 + square)
    return (q2 + reach * reach - square) / 2 if metric == "ip" else 1 - square / 2


def _pivots(x: np.ndarray) -> np.ndarray:
    """Vectors far apart: the first, then always the one farthest from those chosen."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return x[chosen]


def _measured(df: DataFrame, pivots: np.ndarray, metric: str, reach: float, query: bool) -> DataFrame:
    """The rows with ``near``, their distances to the pivots, and ``square``, their squared norm."""
    schema = StructType([*df.schema.fields, StructField("near", ArrayType(DoubleType())), StructField("square", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["embedding"])
                y = _in_space(x, metric, reach, query)
                near = np.sqrt(np.maximum(((y[:, None, :] - pivots[None]) ** 2).sum(2), 0)) if len(y) * pivots.size < 1 << 23 else \
                    np.column_stack([np.sqrt(((y - p) ** 2).sum(1)) for p in pivots])
                yield pdf.assign(near=list(near), square=(x * x).sum(1))
    return df.mapInPandas(run, schema)


def _search(asked: DataFrame, chunks: DataFrame, k: int, metric: str) -> DataFrame:
    """Hits of the queries ``(query_id, embedding, block)`` in their blocks. Both sides of a block come to one task,
    its chunks first; it keeps those and answers the queries batch by batch."""
    none = F.lit(None).cast("string")
    rows = chunks.select("block", F.lit(0).alias("side"), "chunk_id", "doc_id", none.alias("query_id"), "embedding").unionByName(
        asked.select("block", F.lit(1).alias("side"), none.alias("chunk_id"), none.alias("doc_id"), "query_id", "embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, parts, block, c = None, [], None, None
        for pdf in batches:
            for (number, side), own in pdf.groupby(["block", "side"], sort=True):
                if number != here:
                    here, parts, block = number, [], None
                if not side:
                    parts.append(own)
                    continue
                if not parts:
                    continue  # no chunk lies in the block
                if block is None:
                    block = pd.concat(parts, ignore_index=True)
                    c, parts = _matrix(block.pop("embedding")), [True]
                step = max(1, MATRIX_BYTES // (8 * len(block)))
                qids, q = own["query_id"].to_numpy(), _matrix(own["embedding"])
                for at in range(0, len(own), step):
                    yield _best_of(qids[at:at + step], q[at:at + step], block, c, k, metric)
    dealt = rows.repartition("block").sortWithinPartitions("block", "side", "chunk_id", "doc_id")
    return dealt.mapInPandas(run, HIT)


def _blocks(chunks: DataFrame, rows: int, per: int) -> DataFrame:
    """Number the chunks by blocks of about ``per`` rows in the order of the distance to the first pivot. Chunks at
    one distance, as copies are, may overfill a block; it is then split by a hash of the id."""
    ranges, first = min(-(-rows // per), 1000), F.get("near", F.lit(0))
    cuts = chunks.agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)])).first()[0]
    chunks = chunks.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < first)))
    splits = materialise(chunks.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / per).cast("long").alias("splits")))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("splits"))
    return chunks.join(splits, "range").withColumn("block", F.shiftleft(F.col("range").cast("long"), 32) + part).drop("range", "splits")


def knn_join(queries: DataFrame, chunks: DataFrame, k: int, metric: str = "cosine",
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest chunks of every query: ``query_id, doc_id, chunk_id, distance, score, rank``.

    ``queries`` has ``query_id, embedding``; ``chunks`` has ``doc_id, chunk_id, embedding``. Equal scores go by chunk id.
    By the triangle inequality the distances of a query and of a block to a pivot bound the distance between
    them from below; a block is passed over if its highest possible score is below the query's ``k``-th.
    Blocks hold ``block_bytes``, or more where that would make more than ``MOST_BLOCKS`` of them.
    """
    spark = chunks.sparkSession
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    c = chunks.select("doc_id", "chunk_id", "embedding")
    sample = [r["embedding"] for r in c.select("embedding").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], HIT + ", rank int")
    rows, width = c.count(), 8 * max(1, len(sample[0]))
    per = max(1, block_bytes // width, min(BLOCK_BYTES // width, -(-rows // MOST_BLOCKS)))
    best = lambda hits: first_rows(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k, rank="rank")
    if rows <= per:  # one block: every query has to search it
        zero = F.lit(0).cast("long")
        return best(_search(q.withColumn("block", zero), c.withColumn("block", zero), k, metric))
    reach = 0.0
    if metric == "ip":
        norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        reach = float(np.sqrt(c.agg(F.max(norm)).first()[0])) * (1 + 1e-9)
    pivots = _pivots(_in_space(_matrix(sample), metric, reach))
    c = materialise(_measured(c, pivots, metric, reach, query=False))
    c = materialise(_blocks(c, rows, per))
    q = materialise(_measured(q, pivots, metric, reach, query=True))
    vectors, bounds = q.select("query_id", "embedding"), materialise(_bounds(q, c, len(pivots), metric, reach))
    home = bounds.groupBy("query_id").agg(F.max_by("block", F.struct(F.col("most"), -F.col("block"))).alias("block"))
    first = materialise(_search(vectors.join(home, "query_id"), c, k, metric))
    more = _search(vectors.join(_left(bounds, home, first, k).select("query_id", "block"), "query_id"), c, k, metric)
    return best(first.unionByName(more))


def _bounds(q: DataFrame, c: DataFrame, pivots: int, metric: str, reach: float) -> DataFrame:
    """``query_id, block, most``: the highest score any chunk of a block could have, from one row per block."""
    ends = [f(F.get("near", F.lit(i))).alias(f"{n}{i}") for i in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = materialise(c.groupBy("block").agg(*ends))
    listed = q.withColumn("blocks", boxes.agg(F.collect_list("block")).scalar()).withColumn("block", F.explode("blocks"))
    near = [F.get("near", F.lit(i)) for i in range(pivots)]
    lower = F.greatest(F.lit(0.0), *[x for i, n in enumerate(near) for x in (n - F.col(f"hi{i}"), F.col(f"lo{i}") - n)])
    slack = 1e-9 * (1 + F.greatest(F.lit(0.0), *near))
    return listed.join(boxes, "block").select(
        "query_id", "block", _most(F.greatest(lower - slack, F.lit(0.0)), F.col("square"), metric, reach).alias("most"))


def _left(bounds: DataFrame, home: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The blocks that may still hold one of the first ``k``; ties count."""
    floor = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    rest = bounds.join(home.withColumnRenamed("block", "home"), "query_id").where("block <> home").join(floor, "query_id", "left")
    return rest.where(F.col("kth").isNull() | (F.col("most") + 2 * 10.0 ** -PLACES * (1 + F.abs("kth")) >= F.col("kth")))
