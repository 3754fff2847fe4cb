"""Value frequencies over mixed scalars, lists and map values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency_count(df: DataFrame, order: str, scalar: Column | None = None, items: Column | None = None,
                    mapping: Column | None = None) -> DataFrame:
    """Count values; a row may hold a scalar, a list and a map, whose values all count.

    ``first_seen`` is the earliest position of a value, used to settle ties.
    """
    none = F.array().cast("array<string>")
    parts = [F.array(scalar.cast("string"))] if scalar is not None else []
    parts += [F.coalesce(items, none)] if items is not None else []
    parts += [F.coalesce(F.map_values(mapping), none)] if mapping is not None else []
    values = df.select(F.col(order).alias("_row"), F.posexplode(F.concat(*parts)).alias("_pos", "value"))
    return values.where("value is not null").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "_pos")).alias("first_seen"))


def most_common(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "first_seen").limit(n).select("value", "n")


def dominant(counts: DataFrame) -> DataFrame:
    """One row: the most common value, null when there is none."""
    rank = F.struct(F.col("n"), -F.col("first_seen._row"), -F.col("first_seen._pos"))
    return counts.agg(F.max_by("value", rank).alias("value"))


def min_frequency(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n") >= least).select("value", "n")


def normalize(counts: DataFrame) -> DataFrame:
    """Share of each value, four decimals, ties to even."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", F.bround(F.col("n") / total, 4).alias("share"))
