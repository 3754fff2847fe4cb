"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import Scratch


def one_space(text: Column) -> Column:
    """The text with every run of blanks and line breaks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     normalise: Callable[[Column], Column] = one_space,
                     hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: its id, ``keep_id`` (id of the row of its group that stays), ``group_size``,
    ``kept`` and ``text_sha256`` of the normalised text.

    Groups are counted on slim rows (id and hash), so that a group of any size is aggregated before
    it moves. The texts themselves are compared by an aggregate on hash and bytes, in which a task
    sends each different text once. Only where one hash has several texts are the rows of that
    hash read again and told apart by their bytes.

    The row with the smallest id stays; rows without an id come last. Of rows equal in id and text
    exactly one stays. Null and empty texts are one group. In a group without any id ``keep_id`` is
    null. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("id"), normalise(docs[text_col]).alias("norm")).withColumn("hash", hash_of(F.col("norm")))
    rows = scratch.save(texts.select("id", "hash", F.sha2("norm", 256).alias("sha"),
                                     F.monotonically_increasing_id().alias("row")))
    variants = texts.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("copies"))
    collided = scratch.save(variants.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))

    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))

    def groups(some: DataFrame, by: list[str]) -> DataFrame:
        # Written aside: a join with the aggregate itself could not be split where one group has very many rows.
        per = scratch.save(some.groupBy(*by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")))
        return some.join(per, by).select("id", "row", "first", "size", "sha")

    # Rows of a collided hash get the number of their text; it needs the bytes, so only these are read again.
    out = groups(rows.join(collided, "hash", "left_anti"), ["hash"])
    if not collided.isEmpty():
        own = texts.join(collided, "hash", "left_semi").select(
            "id", "norm", "hash", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
        out = out.unionByName(groups(scratch.save(own), ["hash", "norm"]))
    return out.select(
        F.col("id").alias(id_col), F.col("first")["id"].alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first")["row"]).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, as they were read. Where rows share the id and the
    normalised text, the one with the smallest text as written stays."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(docs[id_col].alias("id"), F.sha2(one_space(docs[text_col]), 256).alias("sha"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["sha"] == kept["sha"])
    return rows.join(kept, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", "text").alias("row")).select("row.*")


DEDUP_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)
"""
