"""Document fingerprints: SimHash of weighted terms, and their search by permuted block tables."""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.flat import flat, mix64, pieces, spans_of
from quire.llm.tables import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15
BLOCKS = (11, 11, 11, 11, 10, 10)
SEARCH_RADIUS = 3
BLOCK_ROWS = 2048
QUERY_EVERY = 20
WORK_BYTES = 2 << 20
CLOSED, OPEN, HEAD = 0, 1, 2


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run without white space, A-Z in lower case) and its row."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    rows = len(starts) - 1
    data = np.insert(data, starts[1:], 10)
    starts = starts + np.arange(rows + 1)
    begin, end = spans_of((data != 32) & ((data < 9) | (data > 13)))
    n = len(data)
    up, down, total = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumprod(np.full(n, BASE, np.uint64), out=up[1:])
    np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64), out=down[1:])
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix64((total[end] - total[begin]) * down[begin]), np.searchsorted(starts, begin, side="right") - 1


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct terms: pairs of neighbouring words, or the word of a text
    with one word. The weight grows with the logarithm of the term's count."""
    word, row = word_hashes(*flat(texts))
    pair = np.zeros(len(word), bool)
    pair[:-1] = row[1:] == row[:-1]
    lone = np.bincount(row, minlength=len(texts))[row] == 1
    follow = np.append(word[1:], np.uint64(0))
    term = np.where(pair, mix64(word * np.uint64(3) + follow), word)[pair | lone]
    row = row[pair | lone]
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(term)))
    return row[at], term[at], np.rint(8 * (1 + np.log(count))).astype(np.int16)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit SimHash: every term adds its weight to the bits its hash sets and takes it from the
    others; a bit is set if its sum is above zero. Texts without words have fingerprint zero."""
    out = np.zeros(len(texts), np.uint64)
    row, term, weight = terms(texts)
    if len(row):
        bits = np.unpackbits(term.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.where(bits > 0, weight[:, None], -weight[:, None])
        at = np.flatnonzero(np.diff(row, prepend=-1))
        total = np.add.reduceat(votes, at, axis=0, dtype=np.int64)
        out[row[at]] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def block_keys(fp: Column) -> Column:
    """One key for each choice of three of six bit blocks: the table's number and those blocks side by
    side. Three differing bits leave three blocks untouched, so that all fingerprints within
    ``SEARCH_RADIUS`` bits have a key in common."""
    shifts = list(itertools.accumulate(BLOCKS, initial=0))
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - SEARCH_RADIUS)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, BLOCKS[b]).bitwiseOR(
                F.shiftrightunsigned(fp, shifts[b]).bitwiseAND(F.lit((1 << BLOCKS[b]) - 1)))
        keys.append(key)
    return F.array(*keys)


def _matches(batches: Iterator[pa.RecordBatch], radius: int, chunk: int = 256) -> Iterator[pa.RecordBatch]:
    """For every query of each run of equal ``(key, block, other)`` the fingerprints within ``radius``, as one row."""
    def found(asked: np.ndarray, held: np.ndarray):
        for at in range(0, len(asked), chunk):
            near = np.bitwise_count(asked[at:at + chunk, None] ^ held[None]) <= radius
            hit = np.flatnonzero(near.any(1))
            if len(hit):
                offsets = np.concatenate(([0], np.cumsum(near[hit].sum(1)))).astype(np.int32)
                own = held[np.nonzero(near[hit])[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[at + hit].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.view(np.int64)))], ["query", "found"])

    kept: list[np.ndarray] | None = None

    def runs(columns):
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:3]])
        start = np.flatnonzero(new)
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(new)]):
            asks, fp = columns[3][a:b], columns[4][a:b].view(np.uint64)
            if asks.any() and not asks.all():
                yield from found(fp[asks], fp[~asks])

    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "other", "asks", "fp")]
        kept = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
        if not len(kept[0]):
            continue
        open_from = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in kept[:3]])))
        if open_from:
            yield from runs([x[:open_from] for x in kept])
            kept = [x[open_from:] for x in kept]
    if kept is not None and len(kept[0]):
        yield from runs(kept)


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = SEARCH_RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query, found)``: for each different fingerprint ``fp`` of ``queries`` all different ones of ``prints`` within
    ``radius`` (at most 3) bits, itself included if it is there, in order; without any there is no row.

    Queries and fingerprints meet in 20 permuted block tables (:func:`block_keys`), in buckets that hold a
    query. A bucket of more than ``block_rows`` queries or fingerprints is dealt out by pairs of blocks of
    either side, so that no task holds more than one of each. Null fingerprints match nothing.
    """
    if not 0 <= radius <= SEARCH_RADIUS:
        raise ValueError(f"the block tables reach {SEARCH_RADIUS} bits")

    def tables(df):
        return df.where("fp is not null").select("fp").distinct().select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))

    asked = tables(queries)
    wanted = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("queries"))
    scratch = Scratch(prints.sparkSession)
    held = scratch.save(tables(prints).join(wanted, "key"))
    sizes = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))

    def cells(df, asks):  # own block, and every block of the other side
        n, m = (F.col("queries"), F.col("blocks")) if asks else (F.col("blocks"), F.col("queries"))
        dealt = df.withColumn("home", F.pmod(F.xxhash64("fp"), n).cast("int")).withColumn(
            "mate", F.explode(F.sequence(F.lit(0), m - 1)))
        return dealt.select("key", F.col("home" if asks else "mate").alias("block"),
                            F.col("mate" if asks else "home").alias("other"), F.lit(asks).alias("asks"), "fp")

    large = scratch.save(sizes.join(wanted, "key").where("blocks > 1 or queries > 1"))
    one = F.lit(1)
    dealt = [cells(df.drop("queries").join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", one)).withColumn(
        "queries", F.coalesce("queries", one)), asks) for df, asks in ((asked, True), (held, False))]
    by = ["key", "block", "other"]
    pairs = dealt[0].union(dealt[1]).repartition(*by).sortWithinPartitions(*by, "asks", "fp").mapInArrow(
        lambda batches: _matches(batches, radius), "query long, found array<long>")
    return pairs.groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _compared(texts: list[str], prints: np.ndarray, following: list[str], following_prints: np.ndarray) -> list:
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    edited_prints = fingerprints(pa.array(edited, pa.string()))
    return [[hashlib.sha256(t.encode()).hexdigest() for t in edited], [f"{x:016x}" for x in prints.tolist()],
            [f"{x:016x}" for x in edited_prints.tolist()], likeness(prints, edited_prints), likeness(prints, following_prints)]


RESULT = "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.string()] * 3 + [pa.float64()] * 2


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows of one partition: each but the last is compared with the next one."""
    here = TaskContext.get().partitionId()

    def rows(kind, ids, texts, result, carried):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.int32()), pa.array([here] * n, pa.int32()), ids,
             pa.array([len(t) for t in texts], pa.int64()),
             *[pa.array(c, t) for c, t in zip(result or [[None] * n] * 5, TYPES)],
             pa.array(texts if carried else [None] * n, pa.string())],
            ["kind", "part", "id", "n_chars", *NAMES, "text"])

    last = None
    for batch in batches:
        for part in pieces(batch, "text", WORK_BYTES):
            ids, texts = part.column("id"), ["" if t is None else t for t in part.column("text").to_pylist()]
            prints = fingerprints(part.column("text"))
            if last is None:
                yield rows(HEAD, ids[:1], texts[:1], None, True)
            else:
                ids = pa.concat_arrays([last[0], ids])
                texts, prints = [last[1], *texts], np.concatenate(([last[2]], prints))
            if len(texts) > 1:
                yield rows(CLOSED, ids[:-1], texts[:-1], _compared(texts[:-1], prints[:-1], texts[1:], prints[1:]), False)
            last = ids[-1:], texts[-1], prints[-1]
    if last is not None:
        yield rows(OPEN, last[0], [last[1]], None, True)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", WORK_BYTES):
            texts, following = part.column("text").to_pylist(), part.column("following").to_pylist()
            own = _compared(texts, fingerprints(part.column("text")), following, fingerprints(part.column("following")))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_chars"), *[pa.array(c, t) for c, t in zip(own, TYPES)]],
                ["id", "n_chars", *NAMES])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness to those and to the next one.

    The next text is that of the next smaller id, ids that are null last, equal ids by a hash of
    the text and the text; after the last comes the first. In the edited text the last third of
    the characters gives way to the beginning of the next text. Null counts as empty. Texts are
    shuffled once, into ranges of ids; only the first and the last text of each range are carried
    on, to close the gaps between ranges.
    """
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    order = [F.desc_nulls_last("id"), F.xxhash64("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = slim.schema["id"].dataType.simpleString()
    done = scratch.save(ranged.mapInArrow(_walk, f"kind int, part int, id {kind}, n_chars bigint, {RESULT}, text string"))
    ends = done.where(F.col("kind") == OPEN).select("part", "id", "n_chars", "text")
    heads = done.where(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    every = W.orderBy("part")
    turn = done.where(F.col("kind") == HEAD).select("part").select("part", F.coalesce(
        F.lead("part").over(every), F.min("part").over(W.partitionBy())).alias("next_part"))
    gaps = ends.join(turn, "part").join(heads, "next_part").select("id", "n_chars", "text", "following")
    gaps = gaps.mapInArrow(_finish, f"id {kind}, n_chars bigint, {RESULT}")
    closed = done.where(F.col("kind") == CLOSED).select("id", "n_chars", *NAMES)
    return closed.unionByName(gaps).withColumnRenamed("id", id_col)


def search_documents(found: DataFrame, radius: int = SEARCH_RADIUS, every: int = QUERY_EVERY, id_col: str = "doc_id") -> DataFrame:
    """``found`` (rows of :func:`fingerprint_documents`) with the search for the documents whose id is divisible by
    ``every``: ``near_fingerprints``, all different fingerprints within ``radius`` bits, its own included; null for
    the other documents."""
    done = Scratch(found.sparkSession).save(found)
    signed = F.conv("fingerprint", 16, -10).cast("long")
    asks = F.coalesce(F.pmod(F.col(id_col), F.lit(every)) == 0, F.lit(False))
    prints = done.select(signed.alias("fp"), asks.alias("asks")).groupBy("fp").agg(F.max("asks").alias("asks"))
    prints = Scratch(found.sparkSession).save(prints)
    text = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    near = near_fingerprints(prints, prints.where("asks"), radius).select(
        text(F.col("query")).alias("own"), F.transform("found", text).alias("near_fingerprints"))
    return done.join(near, asks & (F.col("fingerprint") == F.col("own")), "left").drop("own")
