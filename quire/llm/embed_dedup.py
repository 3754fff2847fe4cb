"""Near-duplicate vectors: tiles compared in the order of the principal components."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.tables import Scratch, components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.9
BASIS_ROWS = 4096
BLOCK, TILE = 8192, 1024
STEPS = (16, 32, 64, 128, 256)
GRID = 3
PAIRS_AT_ONCE = 100_000
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def unit(values) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in values])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_basis(vectors: list) -> np.ndarray:
    """Orthonormal directions, those of the largest second moment first."""
    u = unit(vectors)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()


def _tile_links(x, y, rx, ry, sx, sy, threshold, same):
    """Index pairs of one tile with cosine of at least ``threshold``. The product of the leading
    components plus the product of the remaining norms bounds the cosine from above; pairs
    leave as soon as the bound is below the threshold."""
    stages = sorted(sx)
    d = stages[0]
    bound = rx[:, :d] @ ry[:, :d].T + np.outer(sx[d], sy[d])
    a, b = np.nonzero(bound >= threshold - SLACK)
    if same:
        a, b = a[a < b], b[a < b]
    out = []
    for at in range(0, len(a), PAIRS_AT_ONCE):
        i, j = a[at:at + PAIRS_AT_ONCE], b[at:at + PAIRS_AT_ONCE]
        part = np.einsum("ij,ij->i", rx[i, :d], ry[j, :d])
        before = d
        for stage in stages[1:]:
            part += np.einsum("ij,ij->i", rx[i, before:stage], ry[j, before:stage])
            keep = part + sx[stage][i] * sy[stage][j] >= threshold - SLACK
            i, j, part, before = i[keep], j[keep], part[keep], stage
        keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        out.append((i[keep], j[keep]))
    return np.concatenate([p[0] for p in out] or [a[:0]]), np.concatenate([p[1] for p in out] or [b[:0]])


def _apart(rx, ry, leading, threshold):
    """Whether the boxes around two tiles are too far apart in the leading components."""
    gap = np.maximum(rx[:, :leading].min(0) - ry[:, :leading].max(0), ry[:, :leading].min(0) - rx[:, :leading].max(0))
    return (np.maximum(gap, 0) ** 2).sum() > 2 - 2 * threshold + SLACK


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of every index to the smallest one it can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = new


def block_links(pos: np.ndarray, x: np.ndarray, copies: np.ndarray, split: int, basis: np.ndarray, threshold: float):
    """Links between the rows before ``split`` and those behind it (all rows if it is 0): copies linked
    with each row, and links that join the same rows."""
    r = x @ basis
    dim = r.shape[1]
    stages = [d for d in STEPS if d < dim] + [dim]
    rest = np.maximum(np.cumsum((r * r)[:, ::-1], 1)[:, ::-1], 0)
    s = {d: np.sqrt(rest[:, d]) if d < dim else np.zeros(len(r)) for d in stages}
    linked, edges = np.zeros(len(pos), np.int64), []
    rows = range(0, split or len(pos), TILE)
    for i in rows:
        own = slice(i, min(i + TILE, split or len(pos)))
        for j in range(split or i, len(pos), TILE):
            other = slice(j, j + TILE)
            if i != j and _apart(r[own], r[other], stages[0], threshold):
                continue
            a, b = _tile_links(x[own], x[other], r[own], r[other], {d: v[own] for d, v in s.items()},
                               {d: v[other] for d, v in s.items()}, threshold, not split and i == j)
            if len(a):
                a, b = a + own.start, b + j
                linked += np.bincount(a, copies[b], len(pos)).astype(np.int64)
                linked += np.bincount(b, copies[a], len(pos)).astype(np.int64)
                edges.append(_forest(a, b, len(pos)))
    some = np.flatnonzero(linked)
    return some, linked[some], edges


def _links(reps: DataFrame, scratch: Scratch, dim: int, threshold: float, block_rows: int) -> DataFrame:
    """``(a, b, n)``: links between positions, and with null ``b`` the number of vectors linked with ``a``."""
    spark = reps.sparkSession
    share = min(1.0, BASIS_ROWS / max(reps.count(), 1))
    some = reps.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("vec").limit(2 * BASIS_ROWS)
    sample = [r[0] for r in some.collect()]
    basis = spark.sparkContext.broadcast(principal_basis(sample) if sample else np.eye(dim))
    width = float(np.sqrt(2 - 2 * threshold))

    def place(parts):
        for p in parts:
            lead = unit(p["vec"]) @ basis.value[:, :GRID]
            lead = np.pad(lead, ((0, 0), (0, GRID - lead.shape[1])))
            for k in range(GRID):
                p[f"c{k}"] = np.floor(lead[:, k] / width).astype(np.int32)
            p["lead"] = lead[:, 0]
            yield p

    grid = [f"c{k}" for k in range(GRID)]
    kind = reps.schema["vec"].dataType.simpleString()
    placed = reps.select("vec", "key", "n").mapInPandas(
        place, f"vec {kind}, key bigint, n bigint, {', '.join(f'{c} int' for c in grid)}, lead double")
    ordered = placed.repartitionByRange(*grid, "lead").sortWithinPartitions(*grid, "lead")
    ordered = scratch.save(ordered.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("id", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    starts = counts.select("part", F.coalesce(F.sum("rows").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    pos = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = scratch.save(ordered.withColumn("part", part).join(starts, "part").withColumn(
        "block", F.floor(pos / block_rows).cast("long")).select("vec", "key", "n", *grid, "block"))

    held = rows.select("block", *grid).distinct()
    around = held
    for c in grid:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    pairs = around.withColumnRenamed("block", "i").join(held.withColumnRenamed("block", "j"), grid).where("i <= j")
    pairs = scratch.save(pairs.select("i", "j").distinct())
    sides = pairs.select("i", "j", F.col("i").alias("block")).union(
        pairs.where("i < j").select("i", "j", F.col("j").alias("block")))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first = (group["block"] == key[0]).to_numpy()
        order = np.argsort(~first, kind="stable")
        pos, copies = group["key"].to_numpy()[order], group["n"].to_numpy()[order]
        split = int(first.sum()) if key[0] != key[1] else 0
        some, n, edges = block_links(pos, unit(group["vec"].to_numpy()[order]), copies, split, basis.value, threshold)
        out = [pd.DataFrame({"a": pos[some], "b": pd.array([None] * len(some), "Int64"), "n": n})]
        out += [pd.DataFrame({"a": pos[a], "b": pd.array(pos[b], "Int64"), "n": 0}) for a, b in edges]
        return pd.concat(out)

    return rows.select("vec", "key", "n", "block").join(sides, "block").groupBy("i", "j").applyInPandas(
        compare, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                    block_rows: int = BLOCK) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other vectors with cosine of at least ``threshold``),
    ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (it has that id).

    Equal vectors are one until the end. The others are ordered by cells of their three leading
    principal components and cut into blocks; only blocks with neighbouring cells meet, each pair
    of blocks in a task of bounded size, so that a dense cell is spread as well. The basis is fitted
    on about ``BASIS_ROWS`` vectors and any would be exact. Vectors that are null, zero or hold null or
    non-finite components link with nothing; vectors of different lengths neither. Where no id is
    known in a component, ``component_id`` is null. ``threshold`` lies above 0 and below 1.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    scratch = Scratch(vectors.sparkSession)
    source = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("vec"))
    good = source.where(usable(F.col("vec")))
    reps = good.groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    reps = scratch.save(reps.withColumn("key", F.monotonically_increasing_id()))
    found = None
    for dim in [r[0] for r in reps.select(F.size("vec")).distinct().collect()]:
        own = _links(reps.where(F.size("vec") == dim), scratch, dim, threshold, block_rows)
        found = own if found is None else found.union(own)
    plain = source.where(~F.coalesce(usable(F.col("vec")), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = plain
    if found is not None:
        found = scratch.save(found)
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
        roots = components(found.where("b is not null").select("a", "b"), scratch)
        known = reps.join(counts, reps["key"] == counts["a"], "left").join(roots, reps["key"] == roots["node"], "left")
        known = scratch.save(known.select("vec", "low", F.coalesce("root", "key").alias("root"),
                                          (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
        lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
        known = known.join(lows, "root").select(F.col("vec").alias("same"), "n_links", "component_id")
        linked = good.join(known, good["vec"] == known["same"]).select("id", "n_links", "component_id")
        out = linked.union(plain)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


LINKS_SQL = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v),
links as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach as (select x, x as y from links union select r.x, l.y from reach r join links l on r.y = l.x)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(low, e.vec_id) as component_id, coalesce(low, e.vec_id) = e.vec_id as kept
from embeddings e left join (select x, count(*) as n from links group by x) c on c.x = e.vec_id
left join (select x, min(y) as low from reach group by x) m on m.x = e.vec_id
"""
