"""Hard negatives by inner product: STR-packed R-trees, best boxes first, score windows."""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.tables import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)               # per cent of the positive's score
LEAF, FAN = 128, 16
BOXES = 16              # boxes of rows that are read at once
BLOCK_BYTES = 8 << 20           # vectors of a tree, and of the anchors that meet it
ANCHORS_AT_ONCE = 256
LARGEST = float((1 << 63) - 1024)  # the largest double that is a 64-bit integer


def whole_components(vector: Column) -> Column:
    """The components as whole 256ths; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def labelled_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     moved_every: int = 7, labels: int = 10, anchor_every: int = 100) -> DataFrame:
    """``id, label, vec, anchor`` of the rows that take part: every ``moved_every``-th id has the next label, every
    ``anchor_every``-th is an anchor."""
    at, label = F.col(id_col), F.col(label_col)
    moved = F.when(F.pmod(at, F.lit(moved_every)) == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    return vectors.select(at.cast("long").alias("id"), moved.cast("long").alias("label"), whole_components(vectors[vec_col]).alias("vec"),
                          (F.pmod(at, F.lit(anchor_every)) == 0).alias("anchor")).where("id is not null and label is not null and vec is not null")


class Tree:
    """R-tree of the rows of ``x``, packed by sort-tile-recursion: rows are sorted along the coordinate of
    largest spread into slabs, each slab along the next into leaves; boxes are packed alike by their
    centres. ``order`` lists the rows leaf by leaf; the children of a node are neighbours. The root comes first."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.order, cuts = _tiles(x, leaf)
        low, high = (f.reduceat(x[self.order], cuts[:-1]) for f in (np.minimum, np.maximum))
        spans, levels = np.stack((cuts[:-1], cuts[1:]), 1), []
        while len(low) > 1:
            order, cuts = _tiles((low + high) / 2, fan)
            low, high = low[order], high[order]
            levels.append((low, high, spans[order]))
            low, high = np.minimum.reduceat(low, cuts[:-1]), np.maximum.reduceat(high, cuts[:-1])
            spans = np.stack((cuts[:-1], cuts[1:]), 1)
        levels = [(low, high, spans), *reversed(levels)]
        start = np.cumsum([len(level[0]) for level in levels])
        self.low, self.high = (np.concatenate([level[i] for level in levels]) for i in (0, 1))
        self.leaves = int(start[-1]) - len(levels[-1][0])  # nodes from here on hold rows, those before other nodes
        self.spans = np.concatenate([v[2] + (start[i] if i + 1 < len(levels) else 0) for i, v in enumerate(levels)]).tolist()

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with any point of each box."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


def _tiles(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the cuts between groups of at most ``size`` neighbours."""
    groups = -(-len(x) // size)
    if groups <= 1 or not x.shape[1]:
        return np.arange(len(x)), np.append(np.arange(0, len(x), size), len(x))
    spread = np.ptp(x, axis=0)
    first, second = int(spread.argmax()), int(np.argsort(-spread, kind="stable")[min(1, x.shape[1] - 1)])
    order = np.argsort(x[:, first], kind="stable")
    slab = int(np.ceil(np.sqrt(groups))) * size
    order = np.concatenate([s[np.argsort(x[s, second], kind="stable")] for s in (order[i:i + slab] for i in range(0, len(x), slab))])
    return order, np.append(np.arange(0, len(x), size), len(x))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k``: higher scores first, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, allowed, anchor: np.ndarray, low: np.ndarray, high: np.ndarray,
           windows: list[tuple[int, int, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window the best ``k`` rows of a tree for one anchor.

    ``x`` and ``ids`` are in the order of the tree, ``allowed`` tells which of some rows count, ``low`` and
    ``high`` are the anchor's bounds for every box. A window ``(least, most, floor)`` takes scores ``s`` with
    ``least <= 100 s <= most`` and ``s >= floor``. The box with the highest upper bound comes first. A box is passed over
    if it lies outside all windows or strictly below the ``k``-th score of each. The queue gives one box of rows, then
    two, four and so on up to ``BOXES`` at once, as the ``k``-th scores soon change little.
    """
    found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in windows]
    least, most, floors = (np.array(v, np.float64)[:, None] for v in zip(*windows))

    def open_boxes(start: int, end: int) -> np.ndarray:
        top = high[None, start:end]
        return ((top >= floors) & (100 * top >= least) & (100 * low[None, start:end] <= most)).any(0)

    queue, width = [(-high[0], 0)], 1
    while queue:
        leaves = []
        while queue and len(leaves) < width:
            _, node = heapq.heappop(queue)
            if not open_boxes(node, node + 1)[0]:  # the floors may have risen since it was queued
                continue
            start, end = tree.spans[node]
            if node >= tree.leaves:
                leaves.append(np.arange(start, end))
                continue
            for child in (start + np.flatnonzero(open_boxes(start, end))).tolist():
                heapq.heappush(queue, (-high[child], child))
        width = min(2 * width, BOXES)
        if not leaves:
            continue
        rows = np.concatenate(leaves)
        rows = rows[allowed(rows)]
        scores, own = x[rows] @ anchor, ids[rows]
        for w in range(len(windows)):
            some = np.flatnonzero((scores >= floors[w]) & (100 * scores >= least[w]) & (100 * scores <= most[w]))
            if not len(some):
                continue
            s, i = found[w]
            found[w] = _best(np.concatenate((s, scores[some])), np.concatenate((i, own[some])), k)
            if len(found[w][0]) == k:
                floors[w] = max(floors[w, 0], found[w][0][-1])
    return found


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _search_blocks(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``anchor, window, score, id``: what each block of rows has to offer the anchors sent to it.

    ``rows``: ``block, id, label, vec``. ``anchors``: ``block, part, anchor, label, vec, window, least, most, floor`` with one entry
    per window in the last four."""
    def run(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            x, a = _matrix(own["vec"]), _matrix(asked["vec"])
            tree = Tree(x)
            x, ids, labels = x[tree.order], own["id"].to_numpy()[tree.order], own["label"].to_numpy()[tree.order]
            for n, q in enumerate(asked.itertuples(index=False)):
                if n % ANCHORS_AT_ONCE == 0:
                    low, high = tree.bounds(a[n:n + ANCHORS_AT_ONCE])

                def allowed(rows):
                    alike = labels[rows] == q.label
                    return (alike if same_label else ~alike) & (ids[rows] != q.anchor)
                windows, at = list(zip(q.least, q.most, q.floor)), n % ANCHORS_AT_ONCE
                for w, (scores, others) in zip(q.window, search(tree, x, ids, allowed, a[n], low[at], high[at], windows, k)):
                    out.append(pd.DataFrame({"anchor": q.anchor, "window": w, "score": np.clip(scores, -LARGEST, LARGEST).astype(np.int64), "id": others}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "window": [], "score": [], "id": []}, dtype=np.int64)

    return rows.groupBy("block", "part").cogroup(anchors.groupBy("block", "part")).applyInPandas(
        run, "anchor long, window long, score long, id long")


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """The rows with a ``block``: tiles along the first two coordinates, of about ``block_bytes`` of vectors.

    The cuts are quantiles, one per slab and one per tile of a slab. Equal vectors can overfill a
    tile; it is then split by a hash of the id. Vectors of different lengths share no block."""
    rows = rows.withColumns({"dim": F.size("vec"), "c0": F.coalesce(F.get("vec", F.lit(0)), F.lit(0)),
                             "c1": F.coalesce(F.get("vec", F.lit(1)), F.lit(0))})
    per = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.greatest("dim", F.lit(1)))))
    slabs = F.ceil(F.sqrt(F.ceil(F.col("rows") / per))).cast("int")

    def quantiles(of: str) -> Column:
        # At whole per mille: 999 cuts whatever the number of rows.
        return F.percentile_approx(of, [i / 1000 for i in range(1, 1000)], 10000)

    def cell(of: str, cuts: str, n: Column) -> Column:
        below = F.size(F.filter(cuts, lambda q: q < F.col(of)))      # 0 to 999
        return F.floor(below * F.least(n, F.lit(1000)) / 1000).cast("int")

    first = scratch.save(rows.groupBy("dim").agg(quantiles("c0").alias("cuts0"), F.count(F.lit(1)).alias("rows")).select(
        "dim", "cuts0", slabs.alias("slabs")))
    slabbed = rows.join(first, "dim").withColumn("slab", cell("c0", "cuts0", F.col("slabs"))).drop("cuts0")
    second = scratch.save(slabbed.groupBy("dim", "slab").agg(quantiles("c1").alias("cuts1")))
    tiled = slabbed.join(second, ["dim", "slab"]).withColumn("tile", cell("c1", "cuts1", F.col("slabs"))).drop("cuts1")
    tiled = scratch.save(tiled.select("dim", "slab", "tile", "id", "label", "vec", "anchor"))
    full = scratch.save(tiled.groupBy("dim", "slab", "tile").agg(F.ceil(F.count(F.lit(1)) / F.max(per)).cast("int").alias("splits")))
    key = F.xxhash64("dim", "slab", "tile", F.pmod(F.xxhash64("id"), F.col("splits")))
    return scratch.save(tiled.join(full, ["dim", "slab", "tile"]).select(key.alias("block"), "dim", "id", "label", "vec", "anchor"))


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``id, label, vec`` (whole numbers) and ``anchor``. Scores are inner products; higher ones come
    first, ties by smaller id. The positives of an anchor are its first ``positives`` other rows of the same label;
    for each of them the first ``negatives`` rows of another label are returned whose score is ``window`` per
    cent of the positive's.

    The rows are cut into tiles of bounded size. Each tile is an R-tree in a task; anchors first search
    their own tile, whose ``k``-th score then bounds the search of all others from below, so that
    these return little more than the result. Anchors meet the tiles in parts of bounded size.
    Vectors of different lengths have no score. Rows with a null in any of the three columns take no part; repeated rows
    count each for itself, except that a row never meets its own id; of anchors with the same id the one of
    smallest label and vector asks. An empty table gives an empty result. Scores are exact up to 2**46; beyond they are rounded
    as doubles are, and end at 64 bits.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.where("id is not null and label is not null and vec is not null").select(
        "id", "label", F.col("vec").cast("array<long>").alias("vec"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = _packed(rows, scratch, block_bytes)
    asking = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vec", "block", "dim")).alias("q"))
    asking = scratch.save(asking.select(F.col("id").alias("anchor"), "q.*"))
    blocks = scratch.save(rows.select("block", "dim").distinct())
    # Anchors of one length are dealt into parts of about ``block_bytes`` of vectors.
    parts = scratch.save(asking.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(
        F.count(F.lit(1)) * 8 * F.max("dim") / block_bytes)).cast("int").alias("parts")))
    asking = scratch.save(asking.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("anchor"), F.col("parts")).cast("int")))
    spread = rows.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", "part", "id", "label", "vec")
    columns = ["block", "part", "anchor", "label", "vec", "window", "least", "most", "floor"]

    def best(asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``asked``: the anchors with ``window, least, most``. First the own tile, then the others."""
        windows = asked.withColumn("floor", F.transform("window", lambda w: F.lit(float("-inf"))))
        own = scratch.save(_search_blocks(spread, windows.select(*columns), k, same_label))
        floors = own.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(
            F.col("n") >= k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
        others = asked.join(floors, "anchor", "left").withColumnRenamed("block", "home").join(blocks, "dim").where("home <> block")
        floor = F.transform("window", lambda w: F.coalesce(F.col("kth")[w].cast("double"), F.lit(float("-inf"))))
        far = _search_blocks(spread, others.withColumn("floor", floor).select(*columns), k, same_label)
        return scratch.save(_first(own.unionByName(far), k))

    zero, ends = F.array(F.lit(0).cast("long")), [F.array(F.lit(x)) for x in (float("-inf"), float("inf"))]
    alike = best(asking.withColumns({"window": zero, "least": ends[0], "most": ends[1]}), positives, True)
    pairs = alike.select("anchor", F.col("rank").cast("long").alias("window"), F.col("score").alias("positive_score"),
                         F.col("id").alias("positive_id"))
    ranges = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("ps"))
    score = lambda share: F.transform("ps", lambda p: p["positive_score"].cast("double") * share)
    asked = scratch.save(asking.join(ranges, "anchor").withColumns({
        "window": F.transform("ps", lambda p: p["window"]), "least": score(window[0]), "most": score(window[1])}).drop("ps"))
    hard = best(asked, negatives, False)
    return hard.join(pairs, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


NEGATIVES_SQL = f"""
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select a.id as anchor, b.id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.id % 100 = 0 and a.id <> b.id and len(a.e) = len(b.e)),
positives as (
  select anchor, id as positive, score as top from scored where same
  qualify row_number() over (partition by anchor order by score desc, id) <= {POSITIVES}),
negatives as (
  select p.anchor, positive, id as negative, top, score, row_number() over (partition by p.anchor, positive order by score desc, id) as rank
  from positives p join scored s on s.anchor = p.anchor and not s.same
  where {WINDOW[0]} * top <= 100 * score and 100 * score <= {WINDOW[1]} * top)
select anchor as anchor_id, positive as positive_id, rank::int as rank, negative as negative_id, top as positive_score, score as negative_score
from negatives where rank <= {NEGATIVES}
"""
