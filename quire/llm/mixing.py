"""Mixing sources to target weights: Pfair release times and deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.sharding import whole
from quire.llm.tables import Scratch, bucket_starts, free_names

BLOCK_ROWS = 16
NO_SOURCE = "n"


def period(weights: list[int]) -> list[list[int]]:
    """Slots of each source in one period of ``sum(weights)`` slots.

    Block ``k`` of weight ``p`` in a period of ``q`` may not come before slot ``floor(k q / p)`` and has to
    be placed before ``ceil((k + 1) q / p)``. Taking the earliest deadline among the released blocks
    meets all deadlines, so that no source is ever a whole block from its share. Ties go to the
    source named first.
    """
    q = sum(weights)
    coming = [(0, -(-q // p), i, 0) for i, p in enumerate(weights)]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in weights]
    for t in range(q):
        while coming and coming[0][0] <= t:
            _, due, i, k = heapq.heappop(coming)
            heapq.heappush(ready, (due, i, k))
        due, i, k = heapq.heappop(ready)
        assert t < due
        slots[i].append(t)
        if k + 1 < weights[i]:
            heapq.heappush(coming, ((k + 1) * q // weights[i], -(-(k + 2) * q // weights[i]), i, k + 1))
    return slots


def phases(blocks: list[int], weights: list[int]) -> list[list[dict]]:
    """For each source the stretches of its blocks with constant company: first and last block, slot
    of the stretch's begin, period, and the source's slots in it. A stretch ends when a source
    has no more blocks; the others go on with their weights."""
    out: list[list[dict]] = [[] for _ in blocks]
    used, base = [0] * len(blocks), 0
    while live := [i for i, n in enumerate(blocks) if used[i] < n]:
        q = sum(weights[i] for i in live)
        slots = dict(zip(live, period([weights[i] for i in live])))

        def last_slot(i: int) -> int:
            k = blocks[i] - used[i] - 1
            return k // weights[i] * q + slots[i][k % weights[i]]

        end = min(map(last_slot, live)) + 1
        for i in live:
            n = end // q * weights[i] + sum(s < end % q for s in slots[i])
            if n:
                out[i].append({"first": used[i], "last": used[i] + n - 1, "base": base, "q": q, "slots": slots[i]})
            used[i] += n
        base += end
    return out


def mix(docs: DataFrame, weights: Mapping[str | None, int] | None = None, default_weight: int = 1,
        block_rows: int = BLOCK_ROWS, seed: int = 0, source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``block`` (number within its source), ``slot`` (place of the
    block in the mixture) and ``position`` (``slot * block_rows`` plus the row's place in the block).

    A source's rows are shuffled by a hash of the whole row and cut into blocks of ``block_rows``
    rows (the last may be shorter). While a set of sources lasts, each has its share by weight to
    within less than one block at every slot; every row has a place. Null is a source like any
    other; rows equal in all columns take neighbouring places. Weights are whole numbers from 1;
    the sum over all sources should stay below a million, as a period of that length is planned
    on the driver, from the number of rows of each source alone.
    """
    key, h, bucket, before, n, plan, name, rank, block, slot, position = free_names(
        docs, "_key", "_h", "_bucket", "_before", "_n", "_plan", "_name", "_rank", "block", "slot", "position")
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    source = F.col(source_col)
    rows = docs.withColumns({
        key: F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(NO_SOURCE)),
        h: F.xxhash64(F.lit(seed), *[docs[c] for c in docs.columns])})
    rows = rows.withColumn(bucket, F.shiftrightunsigned(F.col(h), 52).cast("int"))
    counts = scratch.save(rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(n)))
    totals = {r[key]: r["total"] for r in counts.groupBy(key).agg(F.sum(n).alias("total")).collect()}
    names = sorted(totals)
    given = {NO_SOURCE if k is None else f"s{k}": w for k, w in (weights or {}).items()}
    share = [int(given.get(k, default_weight)) for k in names]
    if any(w < 1 for w in share):
        raise ValueError("weights must be whole numbers from 1")
    plans = phases([-(-totals[k] // block_rows) for k in names], share)
    table = spark.createDataFrame(
        [(k, [(p["first"], p["last"], p["base"], p["q"], p["slots"]) for p in own]) for k, own in zip(names, plans)],
        f"{name} string, {plan} array<struct<first:bigint,last:bigint,base:bigint,q:bigint,slots:array<bigint>>>")

    starts = bucket_starts(counts, [key], bucket, n, before).drop(n)
    placed = rows.join(starts, [key, bucket])
    within = F.row_number().over(W.partitionBy(key, bucket).orderBy(h)) - 1
    placed = placed.withColumn(rank, F.col(before) + within)
    placed = placed.withColumn(block, whole(F.col(rank), block_rows))
    placed = placed.join(table, F.col(key) == F.col(name))
    at = F.transform(F.filter(plan, lambda p: (p["first"] <= F.col(block)) & (F.col(block) <= p["last"])),
                     lambda p: _slot(p, F.col(block) - p["first"]))[0]
    placed = placed.withColumn(slot, at)
    return placed.select(*docs.columns, block, slot,
                         (F.col(slot) * block_rows + F.pmod(F.col(rank), F.lit(block_rows))).alias(position))


def _slot(p: Column, k: Column) -> Column:
    size = F.size(p["slots"])
    return p["base"] + F.call_function("div", k, size.cast("long")) * p["q"] + F.element_at(
        p["slots"], (F.pmod(k, size.cast("long")) + 1).cast("int"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, without further columns."""
    out = mix(docs, **options)
    return out.orderBy(out.columns[-1]).select(*docs.columns)
