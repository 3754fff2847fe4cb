"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return add


from quire.llm import (  # noqa: E402
    embed_dedup, exact_dedup, hard_negatives, langid, licenses, line_chunks, mixing, near_simhash, pieces, sharding, simhash,
    spelling, toxicity)


@query(embed_dedup.LINKS_SQL)
def op1_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


# Target weights of the mixture; sources not named have weight 1.
MIXTURE = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


@query()
def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs, MIXTURE, block_rows=16, seed=20)


@query()
def op3_langid(spark, sf_dir):
    return langid.predict_languages(table(spark, sf_dir, "documents"))


@query()
def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, seed=20)


@query()
def op5_fingerprints(spark, sf_dir):
    return simhash.search_documents(simhash.fingerprint_documents(table(spark, sf_dir, "documents")))


@query(licenses.SCAN_SQL)
def op6_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op7_sentencepiece(spark, sf_dir):
    import public_tokenizers
    return pieces.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                           ("n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op8_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_simhash_dedup(spark, sf_dir):
    return near_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(line_chunks.CHUNKS_SQL)
def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.drop_repeated_chunks(docs)


@query(hard_negatives.NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings")))


@query(exact_dedup.DEDUP_SQL)
def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query(spelling.VARIANTS_SQL)
def op13_spelling(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents"), altered=spelling.one_letter_less)
    return spelling.spelling_variants(words)
