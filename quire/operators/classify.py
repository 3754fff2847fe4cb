"""Labels for texts, one classification per distinct input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.emotion import emotion_of, prefix


def distinct_classify_join(df: DataFrame, text: Column, classify: Callable[[Column], Column],
                           out: str) -> DataFrame:
    """Classify every distinct text once and join the label back.

    Worth its two shuffles when ``classify`` is a model call. Where one text fills a large share
    of the rows its label is still found once; the join back is left to the optimizer, which
    splits such a key (adaptive skew join) or broadcasts a small label table.
    """
    keyed = df.withColumn("_key", F.md5(F.coalesce(text, F.lit("")))).withColumn("_text", text)
    labels = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text")).select(
        "_key", classify(F.col("_text")).alias(out))
    return keyed.join(labels, "_key").select(*df.columns, out)


def emotion_label(df: DataFrame, text: str = "text", out: str = "emotion") -> DataFrame:
    """Native lexicon label: cheap enough to compute in place, without any shuffle."""
    return df.withColumn(out, emotion_of(prefix(F.col(text))))
