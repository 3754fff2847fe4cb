"""Near-duplicates by SimHash: segment bit counts as a grid, exact bit distance as the check."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm.flat import flat, pieces, spans_of
from quire.llm.tables import Scratch, components, free_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, RADIUS = 4, 4
WORK_BYTES = 1 << 20
HALF_BITS, SEGMENTS = 32, 16
BLOCK = 2048
SMALL = 32


def _shingles(texts: pa.Array, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space behind each, the shingles' starts and ends in them, and
    the shingles before each row."""
    data, starts = flat(texts)
    rows = len(starts) - 1
    data = np.insert(data, starts[1:], 10)  # a line end closes the last word of each row
    starts = starts + np.arange(rows + 1)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    behind = np.zeros(len(data), bool)
    behind[1:] = inside[:-1] & ~inside[1:]
    keep = inside | behind
    text = np.where(inside, data, 32)[keep]
    begin, end = spans_of(inside)
    moved = np.concatenate(([0], np.cumsum(keep)))
    begin, end = moved[begin], moved[end]
    word_row = np.searchsorted(begin, moved[starts])
    words = np.diff(word_row)
    per_row = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    first = np.concatenate(([0], np.cumsum(per_row)))
    n = int(first[-1])
    row = np.repeat(np.arange(rows), per_row)
    head = word_row[:-1][row] + np.arange(n) - first[:-1][row]
    tail = np.minimum(head + size, word_row[1:][row]) - 1
    return text.tobytes(), begin[head], end[tail], first


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of every text: a bit is set if over half of the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    text, begin, end, first = _shingles(texts, size)
    hashes = np.fromiter((xxh64_intdigest(text[a:b], 42) for a, b in zip(begin.tolist(), end.tolist())),
                         np.uint64, len(begin))
    out = np.zeros(len(first) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, first[filled], axis=0, dtype=np.int64)
        majority = votes * 2 > np.diff(first)[filled][:, None]
        out[filled] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """All rows and columns with the fingerprint as a signed long; null counts as empty, and a text
    without words has fingerprint zero. Nothing is shuffled."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    names = [*docs.columns, name]
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in pieces(batch, str(where), WORK_BYTES):
                made = pa.array(fingerprints(part.column(where), size).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names)

    return docs.mapInArrow(run, schema)


def bit_counts(half: Column) -> Column:
    """Bits set in each 2-bit segment of 32 bits, packed into the same 2 bits."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def cells(fp: Column) -> Column:
    """Grid points within Manhattan distance 1 of both halves' bit counts.

    Fingerprints within 4 bits are within 2 bits in one half. There the Manhattan distance of
    their bit counts, which never exceeds the bit distance, is at most 2, so that they have a
    grid point in common; pairs without one are farther apart.
    """
    out = []
    for h in (0, 1):
        half = F.shiftrightunsigned(fp, HALF_BITS * h).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bit_counts(half)
        label = F.lit(h << HALF_BITS)
        out.append(counts + label)
        for i in range(SEGMENTS):
            at, step = F.shiftright(counts, 2 * i).bitwiseAND(F.lit(3)), 1 << (2 * i)
            out += [F.when(at > 0, counts - step + label), F.when(at < 2, counts + step + label)]
    return F.array_compact(F.array(*out))


def _near(block: np.ndarray, radius: int, split: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within ``radius`` in one cell, at most one for each member: every
    member to the first of those it can be reached from. With ``split``, only across it."""
    n = len(block)
    link = np.empty((n, n), bool)
    for at in range(0, n, 256):
        link[at:at + 256] = np.bitwise_count(block[at:at + 256, None] ^ block[None]) <= radius
    if split is not None:
        link[:split, :split] = np.eye(split, dtype=bool)
        link[split:, split:] = np.eye(n - split, dtype=bool)
    label = np.arange(n)
    while True:
        least = np.array([label[row].min() for row in link])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(n))
    return [(block[moved], block[label[moved]])]


def _cell_links(key: np.ndarray, fp: np.ndarray, block: np.ndarray, other: np.ndarray, home: np.ndarray, radius: int):
    """Links within all cells of an ordered stretch; cells are runs of equal ``(key, block, other)``."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(key)))
    found = []
    for at, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist()):
        own = slice(at, at + n)
        split = int((home[own] == block[at]).sum()) if block[at] != other[at] else None
        found += _near(fp[own], radius, split)
    left = np.repeat(start + length, length) - np.arange(len(key))  # rows to the cell's end
    left[np.repeat(length > SMALL, length)] = 0
    step = 1
    at = np.flatnonzero(left > step)
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        found.append((fp[near], fp[near + step]))
        step += 1
        at = at[left[at] > step]
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
    if len(a):
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        a, b = both[:, 0], both[:, 1]
    return a, b


def near_links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, block_rows: int = BLOCK, keys=cells) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints of the column ``fp`` that connect all within
    ``radius`` (at most 4) bits.

    Fingerprints meet in grid cells (see :func:`cells`) and are compared there in Arrow batches.
    Small cells return all their links; a dense cell returns one link per member, which joins the
    same members. A cell of more than ``block_rows`` members is dealt out by pairs of blocks, so
    that no task holds more than two blocks of it. ``keys`` gives the cells of a fingerprint; it
    must give all fingerprints within ``radius`` one in common.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must be 0 to 4 bits")
    rows = prints.select("fp").distinct().select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    rows = scratch.save(rows)
    large = scratch.save(rows.groupBy("key").count().where(F.col("count") > block_rows)
                         .select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    n = F.coalesce(F.col("blocks"), F.lit(1))
    rows = rows.join(large, "key", "left").withColumn("home", F.pmod(F.xxhash64("fp"), n).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), n - 1)))).select(
        "key", F.least("home", "mate").alias("block"), F.greatest("home", "mate").alias("other"), "home", "fp")
    rows = rows.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "home", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("key", "block", "other", "home", "fp")]
            kept = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
            if not len(kept[0]):
                continue
            last_cell = np.logical_and.reduce([x == x[-1] for x in kept[:3]])
            open_from = int(np.argmax(last_cell))  # the last cell may go on in the next batch
            if open_from:
                yield _as_batch(*_cell_links(*_ordered([x[:open_from] for x in kept]), radius))
                kept = [x[open_from:] for x in kept]
        if kept is not None and len(kept[0]):
            yield _as_batch(*_cell_links(*_ordered(kept), radius))

    return rows.mapInArrow(run, "a long, b long")


def _ordered(columns: list[np.ndarray]):
    key, block, other, home, fp = columns
    return key, fp.view(np.uint64), block, other, home


def _as_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def group_labels(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """``(fp, low)``: for each fingerprint the smallest ``low`` of all it is linked with, directly or
    not. ``prints`` has ``fp`` and ``low``, an orderable value of which the smallest is kept."""
    per = scratch.save(prints.groupBy("fp").agg(F.min("low").alias("low")))
    roots = components(near_links(per, scratch, radius), scratch)
    rooted = per.join(roots, per["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("least"))
    return scratch.save(rooted.join(lows, "root").select("fp", F.col("least").alias("low")))


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` and ``component_id``, the smallest id reachable by
    links of at most ``radius`` differing bits, itself included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows without an id
    take part; a group in which no row has one has a null ``component_id``. Repeated rows stay.
    """
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    prints = scratch.save(with_fingerprint(slim, "fp").select("id", "fp"))
    labels = group_labels(prints.select("fp", F.col("id").alias("low")), scratch, radius)
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col), fingerprint_text(F.col("fp")).alias("fingerprint"), F.col("low").alias("component_id"))


def place_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What rows are ordered by: the id, rows without one last, then a hash of the text."""
    return F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("row"))


def keep_places(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose place is in the column ``low`` of ``first``; of rows equal in id and text one."""
    place, low = free_names(docs, "place", "low")
    # In the type of ``low``, or the join would deal the rows out by a cast of the place and the grouping once more.
    kept = docs.withColumn(place, place_of(docs, id_col, text_col).cast(first.schema["low"].dataType)).join(
        first.select(F.col("low").alias(low)), F.col(place) == F.col(low), "left_semi")
    columns = [F.first(docs[c]).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    one = kept.groupBy(place).agg(*columns)
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id (rows without an id last, then
    by a hash of the text), with all its columns. Of rows equal in id and text one stays."""
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(place_of(docs, id_col, text_col).alias("low"), docs[text_col].alias("text"))
    prints = scratch.save(with_fingerprint(slim, "fp").select("fp", "low"))
    first = group_labels(prints, scratch, radius).select("low").distinct()
    return keep_places(docs, first, id_col, text_col)
