"""Ordered operators that never gather a whole key into one task.

A window over ``partitionBy(doc)`` sorts each document in one task, which breaks as soon as one
document holds a large share of the rows. The helpers here cut every key into position blocks,
run the window per ``(key, block)``, and repair the block edges either with copied edge rows
(:func:`with_halo`, :func:`neighbours`) or with a carry, one row per block, that goes before the block's rows
(:func:`running`, :func:`dense_number`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 4096
PAGES_PER_BLOCK = 4096   # pages of a document handled together


def page_block(pages: int = PAGES_PER_BLOCK) -> Column:
    """Pages ordered together; a page holds a bounded number of units."""
    return F.floor(F.coalesce(F.col("page"), F.lit(0)) / pages).cast("long")


def block_of(pos: str | Column, size: int = BLOCK) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, size: int = BLOCK, halo: int = 1):
    """Rows of a gap-free ``pos`` (from 0) by block, each block with ``halo`` rows of its neighbours.

    Returns the rows and a window over ``(keys, block)``; rows whose ``_home`` is not their
    ``_blk`` are the copies, to be taken out by :func:`drop_halo` at the end.
    """
    halo = min(halo, size)
    home, p = block_of(pos, size), F.col(pos) % F.lit(size)
    spread = df.withColumn("_home", home).withColumn(
        "_blk",
        F.explode(F.array_compact(F.array(
            home,
            F.when((p < halo) & (home > 0), home - 1),
            F.when(p >= size - halo, home + 1),
        ))),
    )
    return spread, W.partitionBy(*keys, "_blk").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_home = _blk").drop("_home", "_blk")


def neighbours(df: DataFrame, keys: Sequence[str], pos: str,
               lags: Mapping[str, Column] | None = None,
               leads: Mapping[str, Column] | None = None,
               size: int = BLOCK) -> DataFrame:
    """``lag(expr)`` and ``lead(expr)`` by one row over a gap-free ``pos`` starting at 0, with one
    shuffle on ``(keys, block)``."""
    spread, w = with_halo(df, keys, pos, size)
    cols = {name: F.lag(expr).over(w) for name, expr in (lags or {}).items()}
    cols |= {name: F.lead(expr).over(w) for name, expr in (leads or {}).items()}
    return drop_halo(spread.withColumns(cols))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys are those of ``left``."""
    right = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_same_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], pos: str, *,
            sums: Mapping[str, Column] | None = None,
            lasts: Mapping[str, Column] | None = None,
            maxes: Mapping[str, Column] | None = None,
            size: int = BLOCK, block: Column | None = None, dealt: bool = False) -> DataFrame:
    """Running sum / last non-null value / maximum from the start of the key up to this row.

    Rows are windowed per block; what earlier blocks contribute comes from a summary of one row
    per block, so only ``rows / size`` rows of a key are ever ordered together. Rows that are ``dealt`` out by
    key and block already, with no key null, stay where they are, and the summary comes to them by a join.
    """
    sums, lasts, maxes = dict(sums or {}), dict(lasts or {}), dict(maxes or {})
    base = df.withColumn("_blk", block if block is not None else block_of(pos, size))
    base = base.withColumns({f"_v_{n}": e for n, e in (sums | lasts | maxes).items()})
    here = W.partitionBy(*keys, "_blk").orderBy("_row", pos).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)

    aggs = [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums]
    aggs += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_c_{n}")
             for n in lasts]
    aggs += [F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxes]
    carry = base.groupBy(*keys, "_blk").agg(*aggs)
    carry = carry.select(
        *keys, "_blk",
        *[F.sum(f"_c_{n}").over(before).alias(f"_v_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_v_{n}") for n in lasts],
        *[F.max(f"_c_{n}").over(before).alias(f"_v_{n}") for n in maxes],
    )
    if dealt:
        came = carry.withColumnsRenamed({f"_v_{n}": f"_c_{n}" for n in (*sums, *lasts, *maxes)})
        within = W.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
        out = base.join(came, [*keys, "_blk"]).withColumns(
            {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in sums}
            | {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(within), f"_c_{n}") for n in lasts}
            | {n: F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(within)) for n in maxes})
        return out.select(*df.columns, *sums, *lasts, *maxes)
    out = _with_first(base, carry).withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) for n in sums}
        | {n: F.last(f"_v_{n}", ignorenulls=True).over(here) for n in lasts}
        | {n: F.max(f"_v_{n}").over(here) for n in maxes}
    )
    return out.where("_row").select(*df.columns, *sums, *lasts, *maxes)


def _with_first(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows, and before those of every key and block the row that carries what earlier blocks add. A window that
    begins with it needs no join, so that the rows move once."""
    return rows.withColumn("_row", F.lit(True)).unionByName(carry.withColumn("_row", F.lit(False)), allowMissingColumns=True)


def dense_number(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column],
                 out: str, start: int = 0, census: DataFrame | None = None) -> DataFrame:
    """Gap-free numbering per key. ``block`` must be non-decreasing in ``order`` and bounded.

    ``census`` is a cheaper table that tells how many rows (column ``n``) there are: it has the
    keys and what ``block`` reads. Without one the rows themselves are counted.
    """
    base = df.withColumns({"_blk": block, "_one": F.lit(1).cast("long")})
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    counted = base.withColumn("n", F.lit(1)) if census is None else census.withColumn("_blk", block)
    offset = counted.groupBy(*keys, "_blk").agg(F.sum("n").alias("_n")).select(
        *keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_one"))
    here = W.partitionBy(*keys, "_blk").orderBy("_row", *order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _with_first(base, offset).withColumn(out, (F.sum("_one").over(here) + F.lit(start - 1)).cast("long"))
        .where("_row").select(*df.columns, out)
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
               rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each map partition to ``n`` rows per key before
    the shuffle (window group limit), so a hot key costs no more than ``n`` rows per task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop(name)
