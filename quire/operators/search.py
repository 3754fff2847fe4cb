"""Full-text and keyword search for a table of queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import NO_WORD, tokens
from quire.operators.ordered import first_rows
from quire.session import PACKED, checkpoint_dir, materialise

K1, B = 1.2, 0.75
PLACES = 6
BUCKETS = 1024           # splits of a stored table by document
TERM_BUCKETS = 64        # splits of the index by term
BLOCK_CHUNKS = 256       # chunks of an index block
TABLE_BYTES = 32 << 20   # of blocks that a task counts or scores together
GRAM = 3                 # characters of a join key of substrings
SALT_ROWS = 1 << 20      # texts of a join key before it is split

# Fixed values of this library: frequent English words of more than three letters.
STOP_WORDS = (
    "about", "after", "also", "been", "does", "from", "have", "into", "just", "more", "most", "only", "other",
    "over", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those",
    "very", "were", "what", "when", "where", "which", "while", "will", "with", "would", "your",
)


def query_concepts(query: Column) -> Column:
    """Candidate terms of a query: words of more than three letters, stop words taken out."""
    return F.array_distinct(F.filter(tokens(query), lambda t: (F.length(t) > 3) & ~t.isin(*STOP_WORDS)))


def concept_set(entities: Column, nouns: Column) -> Column:
    """Lower-case union of entities (over two letters) and nouns (over three)."""
    def low(xs, least):
        return F.transform(F.filter(xs, lambda x: F.length(x) > least), lambda x: F.lower(x))
    return F.array_distinct(F.array_union(low(entities, 2), low(nouns, 3)))


def term_keys(concepts: Column) -> Column:
    """Concepts reduced to the characters an index term may hold."""
    return F.filter(F.transform(concepts, lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_-]", "")), lambda c: c != "")


def fulltext_terms(concepts: Column) -> Column:
    """The concepts as one quoted OR expression."""
    return F.array_join(F.transform(term_keys(concepts), lambda c: F.concat(F.lit('"'), c, F.lit('"'))), " OR ")


def doc_bucket(buckets: int = BUCKETS) -> Column:
    """The split of the stored tables that holds a document."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def term_bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """Inverted index in blocks of chunks, as three tables.

    ``postings(term_bucket, term, block, bucket, row, doc_id, tf, length)``; ``maxima(term_bucket, term, block,
    bucket, n, max_tf, min_length)``, one row per term and block, from which follow the term's document frequency and
    an upper bound for every posting of the block; and ``lengths(bucket, block, row, chunk_id, doc_id, emotion, length)``, which
    names the chunks: a posting knows its chunk by a small number within the block. A block holds about
    ``BLOCK_CHUNKS`` chunks of one document bucket, so a frequent word is many blocks and no hot key, and
    replacing a bucket replaces whole blocks. With ``within(chunk_id)`` only those chunks are found; their scores are
    those of the whole index. ``grouped`` is what a new index is written from, a row per term and block; a written index has
    no documents in its postings."""
    postings: DataFrame
    maxima: DataFrame
    lengths: DataFrame
    within: DataFrame | None = None
    grouped: DataFrame | None = None


def build_index(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS, buckets: int = BUCKETS) -> TextIndex:
    """Term counts per chunk. Texts are dealt out by block and counted there, some blocks at a time, so that they move once and
    no posting does."""
    if "emotion" not in chunks.columns:
        chunks = chunks.withColumn("emotion", F.lit(None).cast("string"))
    bucketed = chunks.select("chunk_id", "doc_id", "emotion", "text", doc_bucket(buckets).alias("bucket"))
    # At most one row per bucket; a bucket with many chunks, or with one very long document, has many blocks.
    splits = materialise(bucketed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_chunks).cast("long").alias("_splits")))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("_splits"))
    block = F.shiftleft(F.col("bucket").cast("long"), 32) + part
    row = F.dense_rank().over(W.partitionBy("block").orderBy("doc_id", "chunk_id", "emotion"))
    placed = bucketed.join(splits, "bucket").withColumn("block", block)
    words = placed.repartition("block").select(
        "bucket", "block", row.alias("row"), "doc_id", tokens(F.col("text")).alias("words")).sortWithinPartitions("block")
    # Names and lengths are numbered the same way on their own, without the texts.
    lengths = placed.withColumn("length", F.size(tokens(F.col("text")))).drop("text").repartition("block").select(
        "bucket", "block", row.alias("row"), "chunk_id", "doc_id", "emotion", "length")
    at = "bucket int, block long, term string"
    postings = words.mapInArrow(_count_words(each=True), f"{at}, row int, doc_id {chunks.schema['doc_id'].dataType.simpleString()}, tf long, length int")
    grouped = words.drop("doc_id").mapInArrow(
        _count_words(each=False), f"{at}, n long, max_tf long, min_length int, found array<struct<row:int,tf:int,length:int>>")
    postings, grouped = (t.withColumn("term_bucket", term_bucket()) for t in (postings, grouped))
    return TextIndex(postings, grouped.drop("found"), lengths, grouped=grouped)


def _counted(rows: pa.Table, each: bool) -> pa.Table:
    """Words of whole blocks as their postings, or a row for each word and block with its postings and maxima."""
    rows = rows.combine_chunks()
    block, row, bucket, words = (rows[c].combine_chunks() for c in ("block", "row", "bucket", "words"))
    term = words.flatten().dictionary_encode()
    length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    # Chunks of the same names are one row; copies with other texts differ in length.
    slots, first, slot = np.unique(np.stack((block.to_numpy(), row.to_numpy(), length)), axis=1, return_index=True, return_inverse=True)
    blocks, number = np.unique(slots[0], return_inverse=True)
    n_terms, n_slots = max(len(term.dictionary), 1), max(len(first), 1)
    slot = np.repeat(slot, length)
    key, tf = np.unique((number[slot] * n_terms + term.indices.to_numpy(zero_copy_only=False)) * n_slots + slot, return_counts=True)
    group, slot = key // n_slots, key % n_slots
    row, length = (slots[i][slot].astype(np.int32) for i in (1, 2))
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    of = np.arange(len(key)) if each else begin

    def take(column, at):
        return column.take(pa.array(at))
    out = {"bucket": take(bucket, first[slot[of]]), "block": pa.array(slots[0][slot[of]]), "term": take(term.dictionary, group[of] % n_terms)}
    if each:
        return pa.table(out | {"row": row, "doc_id": take(rows["doc_id"].combine_chunks(), first[slot]), "tf": tf, "length": length})
    found = pa.StructArray.from_arrays([pa.array(x) for x in (row, tf.astype(np.int32), length)], ["row", "tf", "length"])
    n = np.diff(np.append(begin, len(key)))
    most, least = (f.reduceat(x, begin) if len(begin) else x for f, x in ((np.maximum, tf), (np.minimum, length)))
    return pa.table(out | {"n": n, "max_tf": most, "min_length": least,
                           "found": pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)).astype(np.int32)), found)})


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of blocks as tables of about ``TABLE_BYTES`` that hold whole blocks."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.nbytes for b in kept) < TABLE_BYTES:
            continue
        rows = pa.Table.from_batches(kept)
        block = rows["block"].to_numpy()
        last = int(np.searchsorted(block, block[-1]))  # this block may go on
        if last:
            yield rows.slice(0, last)
            kept = rows.slice(last).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _count_words(each: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            yield from _counted(rows, each).to_batches(10_000)
    return run


def block_maxima(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "block", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")).withColumn("term_bucket", term_bucket())


def write_index(index: TextIndex, folder: str) -> None:
    """The tables as parquet. Postings are split by term bucket, so that a search opens those of its terms only, and
    written where they were counted, in the order of terms and blocks. A row is a term's postings in a
    block, beside its maxima."""
    index.grouped.sortWithinPartitions("term_bucket", "term", "block").write.mode("overwrite").option(
        "compression", PACKED).partitionBy("term_bucket").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").option("compression", PACKED).parquet(f"{folder}/lengths")


def stored_index(index: TextIndex, spark: SparkSession) -> TextIndex:
    """The index written to the shared folder and read back."""
    folder = f"{checkpoint_dir(spark)}/quire-index-{uuid.uuid4().hex}"
    write_index(index, folder)
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> TextIndex:
    grouped = spark.read.parquet(f"{folder}/postings")
    postings = grouped.select("term_bucket", "term", "block", "bucket", F.explode("found").alias("_f")).select(
        "term_bucket", "term", "block", "bucket", "_f.*")
    return TextIndex(postings, grouped.drop("found"), spark.read.parquet(f"{folder}/lengths"), grouped=grouped)


def _part(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def for_terms(index: TextIndex, query_terms: DataFrame) -> TextIndex:
    """The index without the folders that hold none of the terms. The list has at most ``TERM_BUCKETS`` numbers."""
    some = F.col("term_bucket").isin([r[0] for r in query_terms.select(term_bucket().alias("b")).distinct().collect()])
    grouped = None if index.grouped is None else index.grouped.where(some)
    return replace(index, postings=index.postings.where(some), maxima=index.maxima.where(some), grouped=grouped)


def block_bounds(query_terms: DataFrame, index: TextIndex, k: int | None) -> DataFrame:
    """``query_id, block, [query_emotion,] terms, bound, first`` for every query and block with a word in common.

    ``bound`` is the largest score a chunk of the block could have: the largest term count and the smallest
    length of the block, per word. ``terms`` are the words that occur there with their weights. ``first`` marks the
    ``k`` blocks with the highest bounds, which hold at least ``k`` hits. Without ``k`` there are neither bounds nor marks, and
    each word is a row of its own.
    """
    corpus = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    n, avg_length = corpus.select("n").scalar(), corpus.select("avg_length").scalar()
    asked = query_terms.distinct()
    held = index.maxima.join(asked.select("term").distinct(), "term", "left_semi")
    held = materialise(held.select("term", "block", "n", "max_tf", "min_length"))
    df = F.sum("n")
    weights = held.groupBy("term").agg(F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    emotion = [c for c in ("query_emotion",) if c in asked.columns]
    bound = F.sum(F.col("idf") * _part(F.col("max_tf"), F.col("min_length"), avg_length))
    met = asked.join(weights, "term").join(held, "term")
    if k is None:  # nothing to choose, so the words of a block need not be brought together
        return met.select("query_id", "block", *emotion, F.array(F.struct("term", "idf")).alias("terms"))
    out = met.groupBy("query_id", "block", *emotion).agg(
        bound.alias("bound"), F.collect_list(F.struct("term", "idf")).alias("terms"))
    best = W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    return out.withColumn("first", F.row_number().over(best) <= k)


def asked_index(index: TextIndex, query_terms: DataFrame) -> TextIndex:
    """What an index has of the terms, written once: all later steps read it several times. The terms alone are a small table."""
    index = for_terms(index, query_terms)
    if index.grouped is None:
        return index
    terms = materialise(query_terms.select("term").distinct())
    grouped = materialise(index.grouped.join(terms, "term", "left_semi"))
    return replace(index, grouped=grouped, maxima=grouped.drop("found"))


POSTING = ("row", "tf", "length")


def _found(index: TextIndex) -> DataFrame:
    """Postings as they move: ``block, term`` and one array of numbers for each part of a posting."""
    if index.grouped is not None:
        return index.grouped.select("block", "term", *[F.col(f"found.{c}").alias(c) for c in POSTING])
    return index.postings.select("block", "term", *[F.array(F.col(c).cast("int")).alias(c) for c in POSTING])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists and their number in each; null is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """Equal numbers for equal values of all the columns, from 0; null is -1."""
    codes = pa.concat_arrays(columns).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges of ``n`` from ``start``, and which range each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


def _scored(rows: pa.Table, avg_length: float, k: int | None) -> pa.Table:
    """Hits of whole blocks: chunks by the sum of their postings' parts of the score for each query. With ``k`` only those that may be
    among a query's first ``k`` of these blocks, ties included."""
    named, found, asked = (rows.filter(pa.array(rows["side"].to_numpy() == i)).combine_chunks() for i in range(3))

    def column(table, name):
        return table[name].combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)
    block = [t["block"].to_numpy() for t in (named, found, asked)]
    blocks = np.unique(np.concatenate(block))
    in_named, in_found, in_asked = (np.searchsorted(blocks, b) for b in block)
    # Postings one by one, each with its part of the score but for the weight of the term.
    (row, size), (tf, _), (length, _) = (_flat(column(found, c)) for c in POSTING)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))
    begin = np.cumsum(size) - size
    # The words asked of a block meet its rows of postings.
    idf, words = _flat(column(asked, "idfs"))
    who_row = np.repeat(np.arange(asked.num_rows), words)
    of_found, of_words = _codes(column(found, "term"), column(asked, "terms").flatten())
    width = 1 + max(of_found.max(initial=0), of_words.max(initial=0))
    key = in_found * width + of_found
    order = np.argsort(key, kind="stable")
    want = in_asked[who_row] * width + of_words
    low = np.searchsorted(key[order], want)
    at, word = _ranges(low, np.searchsorted(key[order], want, side="right") - low)
    at = order[at]
    posting, pair = _ranges(begin[at], size[at])
    word = word[pair]
    # Chunks by block and row; those that are not searched have no name here.
    high = 1 + max(row.max(initial=0), (names := _flat(column(named, "row"))[0]).max(initial=0))
    chunks, first = np.unique(in_named * high + names, return_index=True)
    spot = in_asked[who_row[word]] * high + row[posting]
    chunk = np.minimum(np.searchsorted(chunks, spot), max(len(chunks) - 1, 0))
    known = chunks[chunk] == spot if len(chunks) else np.zeros(len(spot), bool)
    posting, word, chunk = posting[known], word[known], chunk[known]
    # Parts of one chunk and query come together.
    query, = _codes(column(asked, "query_id"))
    felt, asked_felt = _codes(column(named, "emotion"), column(asked, "query_emotion"))
    _, asker, who = np.unique(np.stack((query, asked_felt)), axis=1, return_index=True, return_inverse=True)
    hit, of = np.unique(who[who_row[word]] * max(len(chunks), 1) + chunk, return_inverse=True)
    score = np.bincount(of, idf[word] * part[posting], len(hit))
    who, chunk = asker[hit // max(len(chunks), 1)], first[hit % max(len(chunks), 1)]
    some = (asked_felt[who] < 0) | (asked_felt[who] == felt[chunk])
    who, chunk, score = who[some], chunk[some], score[some]
    if k is not None and len(who):
        order = np.lexsort((-score, query[who]))
        who, chunk, score = who[order], chunk[order], score[order]
        start = np.searchsorted(query[who], query[who])
        end = np.searchsorted(query[who], query[who], side="right")
        last = score[np.minimum(start + k, end) - 1]
        some = score >= last - 2 * 10.0 ** -PLACES
        who, chunk, score = who[some], chunk[some], score[some]
    return pa.table([column(asked, "query_id").take(pa.array(who)), *(column(named, c).take(pa.array(chunk)) for c in ("doc_id", "chunk_id", "emotion")),
                     pa.array(score)], ["query_id", "doc_id", "chunk_id", "emotion", "score"])


def _score_blocks(avg_length: float, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            yield from _scored(rows, avg_length, k).to_batches(10_000)
    return run


def _block_hits(wanted: DataFrame, index: TextIndex, few: bool = False, k: int | None = None) -> DataFrame:
    """Scores of the chunks of the wanted blocks (see :func:`block_bounds`); with ``k`` at least the first ``k`` of each query.

    What is asked of a block, its postings of the terms and the names of its chunks are dealt out by block as rows of one
    table. A task scores some blocks at a time, so that a posting moves once and a score not at all. Where each query wants a
    ``few`` blocks only, postings of a term that nobody asks of their block stay behind."""
    avg_length = index.lengths.agg(F.avg("length")).first()[0] or 1.0
    who = [c for c in ("query_id", "query_emotion") if c in wanted.columns]
    asked = wanted.select("block", *who, "terms")
    blocks = asked.select("block").distinct()
    found = _found(index)
    if few:
        held = asked.select("block", F.explode("terms.term").alias("term")).distinct()
        found = found.join(held, ["block", "term"], "left_semi")
    named = index.lengths if index.within is None else index.lengths.join(
        index.within.select("chunk_id"), "chunk_id", "left_semi")
    named = named.join(blocks, "block", "left_semi").select(
        "block", F.lit(0).alias("side"), F.array(F.col("row").cast("int")).alias("row"), "doc_id", "chunk_id", "emotion")
    found = found.select("block", F.lit(1).alias("side"), "term", *POSTING)
    asked = asked.withColumns({"side": F.lit(2), "idfs": F.col("terms.idf"), "terms": F.col("terms.term")}).withColumns(
        {c: F.lit(None).cast("string") for c in ("query_emotion",) if c not in who})
    dealt = named.unionByName(found, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    schema = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id", "chunk_id", "emotion"))
    hits = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(
        _score_blocks(float(avg_length), k), f"{schema}, score double")
    return hits.withColumn("score", F.round("score", PLACES))


def bm25_search(query_terms: DataFrame, index: TextIndex, k: int | None = None) -> DataFrame:
    """Chunks by BM25 for ``query_terms(query_id, term[, query_emotion])``: ``query_id, doc_id, chunk_id, emotion, score``,
    and with ``k`` the first ``k`` with their ``rank``. Where a query has an emotion only chunks of that emotion count.

    The most promising blocks of each query are scored first. Blocks whose bound stays below the ``k``-th score found
    there cannot hold one of the first ``k`` and are not read; all others are, so the result is exact. A query
    with fewer than ``k`` hits in the first blocks has all its blocks read.
    """
    index = asked_index(index, query_terms)
    bounds = block_bounds(query_terms, index, k)
    if k is None:
        return _block_hits(bounds, index)
    bounds = materialise(bounds)
    first = materialise(fulltext_overfetch(_block_hits(bounds.where("first"), index, few=True, k=k), k, 1))
    rest = materialise(blocks_left(bounds, first, k))
    hits = first.drop("rank").unionByName(_block_hits(rest, index, k=k))
    return fulltext_overfetch(hits, k, 1)


def blocks_left(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The blocks that may still hold one of the first ``k``; ties count."""
    floor = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k)
    return bounds.where(~F.col("first")).join(floor, "query_id", "left").where(
        F.col("_kth").isNull() | (F.col("bound") + 2 * 10.0 ** -PLACES >= F.col("_kth"))).drop("_n", "_kth")


def fulltext_overfetch(hits: DataFrame, k: int, times: int = 3) -> DataFrame:
    """The ``times * k`` best per query."""
    return first_rows(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], times * k, rank="rank")


def fulltext_score_scale(score: Column) -> Column:
    return F.when(score.isNull(), 0.6).otherwise(F.least(F.lit(1.0), 0.4 + score / 10.0))


def fulltext_source(score: Column) -> Column:
    return F.when(score.isNotNull(), "graph_fulltext").otherwise("graph_keyword")


def _grams(text: Column, size: int) -> Column:
    """The different stretches of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _longest_word(term: Column) -> Column:
    """The longest run of letters and digits of a term, or nothing. A text that contains the term has it within a word."""
    words = F.transform(F.split(term, NO_WORD), lambda w: F.struct(F.length(w).alias("size"), w.alias("word")))
    return F.array_max(words)["word"]


def _words_with(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs ``run, word`` of the words (each once) that contain a run (each once, none empty).

    A substring test has no equality to join on, so one is made: a word that contains a run contains
    each of its stretches of three characters (shorter runs: the run itself). Of these the one
    that fewest words have is the run's key. Words meet runs by key, and what meets is tested. A run with a
    stretch that no word has is out at once."""
    runs = materialise(runs.withColumn("size", F.least(F.length("run"), F.lit(GRAM))))
    sizes = [r[0] for r in runs.select("size").distinct().collect()]  # at most GRAM numbers

    def grams_of(df: DataFrame, text: str, size: int) -> DataFrame:
        return df.select(text, F.explode(_grams(F.col(text), size)).alias("gram"))
    of_runs, of_words = (df.select(c, F.lit("").alias("gram")).where("false") for df, c in ((runs, "run"), (words, "word")))
    for size in sizes:
        of_runs = of_runs.union(grams_of(runs.where(F.col("size") == size), "run", size))
        of_words = of_words.union(grams_of(words, "word", size))
    counts = of_words.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = of_runs.join(counts, "gram").groupBy("run").agg(
        F.min(F.struct("n", "gram")).alias("key"), F.count(F.lit(1)).alias("held"))
    whole = runs.select("run", F.size(_grams_by_size(F.col("run"), F.col("size"), sizes)).alias("grams"))
    keys = keys.join(whole, "run").where("held = grams").select("run", "key.gram")
    return of_words.join(materialise(keys), "gram").where(F.contains("word", "run")).select("run", "word")


def _grams_by_size(text: Column, size: Column, sizes: list[int]) -> Column:
    out = F.array().cast("array<string>")
    for n in sizes:
        out = F.when(size == n, _grams(text, n)).otherwise(out)
    return out


def keyword_theta_join(query_terms: DataFrame, chunks: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Pairs of query and chunk where the chunk contains any of the query's terms, ignoring the chunk's case.

    A text contains a term only if one of its words contains the term's longest run of letters and digits. So the different words of
    all texts are searched for the runs (:func:`_words_with`), and texts meet terms by word. A term that is one run is then found; any
    other is tested on the text, and one without such a run on every text. Words are counted before they move, and one that
    more than ``salt_rows`` texts have is joined in that many parts. Null and empty terms match nothing.
    """
    asked = query_terms.where("term <> ''").select("query_id", "term").distinct()
    terms = materialise(asked.groupBy("term").agg(F.collect_list("query_id").alias("queries")).withColumn("run", _longest_word(F.col("term"))))
    # A chunk moves as 128 bits made of its names.
    key = ["_a", "_b"]
    low = chunks.where("text is not null and chunk_id is not null").select(
        F.xxhash64("chunk_id", "doc_id").alias("_a"), F.xxhash64(F.lit(1), "chunk_id", F.isnull("doc_id"), "doc_id").alias("_b"),
        "chunk_id", "doc_id", F.lower("text").alias("low"))
    words = low.select(*key, F.explode(F.array_union(F.split("low", NO_WORD), F.array(F.lit("")))).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    runs = terms.select("run").distinct()
    found = _words_with(runs.where("run <> ''"), counts.select("word").where("word <> ''")).union(
        runs.where("run = ''").select("run", F.col("run").alias("word")))
    whole = F.col("term") == F.col("run")
    met = found.join(terms, "run").groupBy("word").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(whole, F.col("queries"))))).alias("term_queries"),
        F.collect_list(F.when(~whole, F.struct("term", "queries"))).alias("terms"))
    met = materialise(met.join(counts, "word").select("word", "term_queries", "terms", F.ceil(F.col("n") / salt_rows).cast("int").alias("parts")))
    frequent = materialise(met.where("parts > 1").select("word", "parts"))
    # The parts of a frequent word go by chunk.
    rows = words.join(frequent, "word", "left").select(
        *key, "word", F.pmod(F.col("_a"), F.coalesce("parts", F.lit(1))).alias("part"))
    dealt = met.select("word", "term_queries", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    # What is found and what may stand in a chunk move as one row with it.
    held = rows.join(dealt, ["word", "part"]).groupBy(*key).agg(
        F.array_distinct(F.flatten(F.collect_set("term_queries"))).alias("queries"),
        F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"))
    if terms.where(~whole).isEmpty():  # nothing to test, so the texts stay where they are
        hits = held.join(low.select(*key, "chunk_id", "doc_id").distinct(), key)
    else:
        tested = F.flatten(F.transform(F.filter("terms", lambda t: F.contains(F.col("low"), t["term"])), lambda t: t["queries"]))
        hits = held.join(low, key).select("chunk_id", "doc_id", F.concat("queries", tested).alias("queries"))
        hits = hits.groupBy("chunk_id", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))
    return hits.select(F.explode("queries").alias("query_id"), "doc_id", "chunk_id")
