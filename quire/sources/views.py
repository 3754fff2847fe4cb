"""Inputs derived from the given tables: lines, spans, table-of-contents rows, messages, ...

Each recipe is a projection or one window over a whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordered import block_of, dense_number
from quire.session import spread


# Tables whose rows are long texts: the work per row is worth an even spread.
TEXT_TABLES = ("documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def lines(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "text"),
    )


def spans(spark, sf_dir) -> DataFrame:
    n = F.col("line_no")
    return lines(spark, sf_dir).select(
        "doc_id", (F.floor(n / 5) + 1).cast("int").alias("page"), "line_no", "text",
        F.when(n == 0, 18.0).when(F.length("text") < 60, 14.0).otherwise(10.0).alias("size"),
        (60.0 + 150 * (n % 5)).alias("y0"), (72.0 + 150 * (n % 5)).alias("y1"),
        F.lit(792.0).alias("page_height"), F.lit(0).alias("span_no"),
    )


def split_spans(spark, sf_dir) -> DataFrame:
    """The same lines cut into spans of up to 40 characters."""
    n = F.ceil(F.length("text") / 40) - 1
    return (
        spans(spark, sf_dir)
        .withColumn("span_no", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))))
        .withColumn("text", F.substring(F.col("text"), F.col("span_no") * 40 + 1, F.lit(40)))
    )


def page_texts(spark, sf_dir) -> DataFrame:
    """Five lines make a page."""
    d = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("l"))
    last = F.floor((F.size("l") - 1) / 5).cast("int")
    return d.withColumn("page_index", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id", "page_index",
        F.array_join(F.slice("l", F.col("page_index") * 5 + 1, F.lit(5)), "\n").alias("text"))


def _numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    return dense_number(df, [key], block_of(order), [F.col(order)], "rn")


def toc_lines(spark, sf_dir) -> DataFrame:
    """Rows of printed contents pages: eight rows a page, four row styles."""
    rn, name, size = F.col("rn"), F.col("p_name"), F.col("p_size")
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_name", "p_size")
    return _numbered(part, "doc_id", "p_partkey").select(
        "doc_id", F.floor(rn / 8).cast("int").alias("page_index"),
        (rn % 8 * 20).cast("double").alias("y0"), F.lit(50.0).alias("x0"),
        F.when(rn % 4 == 0, F.concat(F.lit("Chapter "), name, F.lit(" ..... "), size))
        .when(rn % 4 == 1, F.concat(rn % 9 + 1, F.lit("."), rn % 3 + 1, F.lit(" "), name, F.lit(" .... "), size))
        .when(rn % 4 == 2, F.concat(rn % 9 + 1, F.lit(". "), name, F.lit(" "), size))
        .otherwise(F.concat(name, F.lit(" xiv"))).alias("text"))


def toc_blocks(spark, sf_dir) -> DataFrame:
    """The same rows as two boxes each: the title, and the label one point lower to its right."""
    t = toc_lines(spark, sf_dir)
    return t.select(
        "doc_id", "page_index", F.explode(F.array(
            F.struct(F.lit(400.0).alias("x0"), (F.col("y0") + 1).alias("y0"),
                     F.regexp_extract("text", "[^ ]+$", 0).alias("text")),
            F.struct(F.col("x0"), F.col("y0"), F.regexp_replace("text", " [^ ]+$", "").alias("text")),
        )).alias("b")).select("doc_id", "page_index", F.lit(0).alias("block_no"), "b.x0", "b.y0", "b.text")


def page_numbers(spark, sf_dir) -> DataFrame:
    """Printed numbers found on pages: true offset ``doc_id % 7``, some noise, some missing."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), "c_custkey")
    phys, key = F.col("phys"), F.col("c_custkey")
    return (
        _numbered(c, "doc_id", "c_custkey").withColumnRenamed("rn", "phys")
        .withColumn("printed", F.when(key % 5 == 0, key % 50 + 1).otherwise(phys - F.col("doc_id") % 7 + 1))
        .where((key % 11 != 0) & (F.col("printed") >= 1))
        .select("doc_id", "phys", F.lit(0).alias("pos"), "printed"))


def number_blocks(spark, sf_dir) -> DataFrame:
    """Text boxes at varying heights of a page, some with digits and roman words."""
    c = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("doc_id"), "c_custkey", "c_name", "c_mktsegment")
    key = F.col("c_custkey")
    y = (key % 10).cast("double") * 79.2
    return _numbered(c, "doc_id", "c_custkey").select(
        "doc_id", F.col("rn").alias("page_index"), y.alias("y0"), (y + 12).alias("y1"),
        F.lit(792.0).alias("page_height"),
        F.concat("c_name", F.lit(" "), key % 1000, F.lit(" "), "c_mktsegment",
                 F.when(key % 4 == 0, " xiv").when(key % 4 == 1, " IX mm").otherwise("")).alias("text"))


def messages(spark, sf_dir) -> DataFrame:
    return spark.sql("""
      select cast(conv_id % 10 as string) user_id, concat('thread_', conv_id) thread_id,
             1000*conv_id + turn as seq, role, text as content,
             timestampadd(SECOND, cast(turn as int), timestampadd(HOUR, cast(conv_id as int),
                 timestamp_ntz'2024-01-01 00:00:00')) as ts
      from {c}""", c=load(spark, sf_dir, "conversations"))


def queries(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def query_vectors(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"), "embedding")


def chunk_vectors(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("d"), "label").alias("doc_id"),
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")


def noisy(spark, sf_dir) -> DataFrame:
    """Document texts with the defects the cleaners repair worked in."""
    t = F.col("text")
    for a, b in ((", ", " ..... "), (". ", "- "), (" de ", " —__ "), (" the ", " “x” [12] "),
                 (" und ", " … ‡ é ?!! ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return load(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


def registry(spark, sf_dir) -> DataFrame:
    """Registry rows of all documents; copies of one text share a content id."""
    return load(spark, sf_dir, "documents").select(
        F.substring(F.sha2("text", 256), 1, 16).alias("doc_id"),
        F.substring("text", 1, 40).alias("title"),
        F.concat(F.lit("data/"), "source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("source_path"),
        F.ceil(F.col("n_chars") / 3000).cast("long").alias("total_pages"),
        F.col("doc_id").alias("seq"),
    )
