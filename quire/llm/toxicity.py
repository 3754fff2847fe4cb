"""Toxicity: support vector machine over a gap-weighted subsequence kernel of words."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.flat import distinct, flat, pieces, spans_of
from quire.llm.tables import Scratch, free_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS = 20_000
LANDMARKS = 96
SUSPECTS = 600
SPAN, DECAY = 8, 0.6
WINDOW, STRIDE = 16, 8
OPEN, CLOSE, SPACE = 30, 31, 255
PENALTY, RIDGE = 1e-3, 0.3
WORK_BYTES = 1 << 20
COUNT_PARTS = 16
TOP = 3
CASES = ["pos", "neg", "worst_pos", "worst_neg"]


def alphabet() -> np.ndarray:
    """Symbol of every code point: 1-26 letters without case, 27 é, 28 other accented Latin letters,
    29 letters of other scripts, 255 white space, 0 the rest, which is a gap in a word."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isspace():
            out[cp] = SPACE
        elif c.isalpha():
            low = c.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 if low == "é" else 28 if cp < 0x250 else 29
    return out


def words(texts: pa.Array, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, which, kinds)`` of all words with three letters or more, as symbols between an
    opening and a closing one.

    Three or more single letters in a row are read as one word with gaps. A word of more than
    ``WINDOW`` symbols is read in overlapping windows without opening and closing.
    """
    data, starts = flat(texts)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[starts]
    sym = np.insert(symbols[cp], begins, SPACE)
    row_at = begins + np.arange(len(begins))
    begin, end = spans_of(sym != SPACE)
    row = np.searchsorted(row_at, begin, side="right") - 1
    single = (end - begin == 1) & (sym[begin] > 0)
    same = np.zeros(len(begin), bool)
    same[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    run = np.cumsum(~same) - 1
    spelled = (np.bincount(run, minlength=1)[run] >= 3) if len(run) else single
    head = ~(spelled & same)
    last = np.append(head[1:], True)[:len(head)]
    begin, end, row = begin[head], end[last], row[head]
    letters = np.flatnonzero((sym > 0) & (sym < OPEN))
    low, high = np.searchsorted(letters, begin), np.searchsorted(letters, end)
    enough = high - low >= 3
    begin, end, row = letters[low[enough]], letters[high[enough] - 1] + 1, row[enough]
    windows = np.maximum(-(-(end - begin - WINDOW) // STRIDE), 0) + 1
    of = np.repeat(np.arange(len(begin)), windows)
    k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    whole = windows[of] == 1
    begin = begin[of] + STRIDE * k
    end = np.minimum(begin + np.where(whole, end[of] - begin, WINDOW), end[of])
    offset = np.concatenate(([0], np.cumsum(end - begin + 2)))
    buffer = sym[np.repeat(begin - 1 - offset[:-1], end - begin + 2) + np.arange(offset[-1])]
    buffer[buffer == SPACE] = 0
    buffer[offset[:-1]], buffer[offset[1:] - 1] = np.where(whole, OPEN, 0), np.where(whole, CLOSE, 0)
    which, kinds = distinct(pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(offset), pa.py_buffer(buffer)]))
    return row[of], which, kinds


def _padded(kinds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = kinds.cast(pa.large_binary())
    at = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset:kinds.offset + len(kinds) + 1]
    sym = np.frombuffer(kinds.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    word = np.repeat(np.arange(len(kinds)), np.diff(at))
    where = np.arange(len(sym)) + SPAN * word
    out = np.zeros(len(sym) + SPAN * len(kinds) + SPAN, np.int32)
    out[where] = sym
    own = sym > 0
    return out, where[own], word[own]


def _triples(sym: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Codes of all subsequences of three symbols spanning at most ``SPAN + 1``, by their span."""
    first = sym[at] << 10
    for a in range(1, SPAN):
        pair = first | (sym[at + a] << 5)
        for b in range(a + 1, SPAN + 1):
            yield np.where((pair & 0x3E0) > 0, pair | sym[at + b], 0), b + 1


def _length(sym: np.ndarray, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Norm of each word's subsequence weights, every occurrence counted by itself."""
    total, seen = np.zeros(len(at)), np.zeros(len(at))
    for b in range(1, SPAN + 1):
        here = sym[at + b] > 0
        total += here * seen * DECAY ** (2 * (b + 1))
        seen += here
    return np.sqrt(np.maximum(np.bincount(word, total, n), 1e-12))


def subsequences(kinds: pa.Array) -> np.ndarray:
    """Normalised weights of all symbol triples, one row per word. For few words only."""
    sym, at, word = _padded(kinds)
    out = np.zeros((len(kinds), 1 << 15))
    for code, span in _triples(sym, at):
        own = (code & 31) > 0
        np.add.at(out, (word[own], code[own]), DECAY ** span)
    return out / _length(sym, at, word, len(kinds))[:, None]


def word_margins(kinds: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Inner products of each word's subsequence weights with each row of ``weights`` of all triples."""
    sym, at, word = _padded(kinds)
    total = np.zeros((len(weights), len(at)), np.float32)
    for code, span in _triples(sym, at):
        for k, own in enumerate(weights):
            total[k] += own[code] * np.float32(DECAY ** span)
    return np.stack([np.bincount(word, t, len(kinds)) for t in total]) / _length(sym, at, word, len(kinds))


@dataclass
class Model:
    """The classifier in primal form: one weight for each symbol triple and machine. The first machine
    tells suspect words, the second one those that suffice alone."""
    symbols: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray  # of the features, see _features

    def score(self, best: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = _features(best, n_words) @ self.slope
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(best: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack((best, np.log1p(n_words), np.ones(len(best))))


def _ranked(model: Model, texts: pa.Array):
    """``(row, which, margins, rank, kinds, counts)``: the different words of each text, by the first
    machine from the worst on, and the number of all its words."""
    row, which, kinds = words(texts, model.symbols)
    counts = np.bincount(row, minlength=len(texts))
    if not len(row):
        return row, which, np.zeros((len(model.weights), 0)), row, kinds, counts
    row, which = np.divmod(np.unique(row * len(kinds) + which), len(kinds))
    margins = (word_margins(kinds, model.weights) + model.bias[:, None])[:, which]
    order = np.lexsort((which, -margins[0], row))
    row, which, margins = row[order], which[order], margins[:, order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, which, margins, rank, kinds, counts


def _best(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ``TOP`` highest margins of different words by the first machine and the highest one by the
    second, for each text, and its number of words. A word that is not there has the bias."""
    row, _, margins, rank, _, counts = _ranked(model, texts)
    best, shown = np.full((len(texts), TOP + 1), model.bias[0]), rank < TOP
    best[row[shown], rank[shown]] = margins[0, shown]
    best[:, TOP] = model.bias[-1]
    if len(row):
        first = np.flatnonzero(rank == 0)
        best[row[first], TOP] = np.maximum.reduceat(margins[-1], first)
    return best, counts


def _solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Linear support vector machine (squared hinge loss) by Newton steps; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), PENALTY * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    weight = weight / weight.sum()
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active] + 1e-9 * np.eye(len(w)), a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _balanced(pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word as a positive and as a negative case, both classes with the same total weight."""
    y = np.repeat([1.0, -1.0], len(pos))
    return np.tile(np.arange(len(pos)), 2), y, np.concatenate((pos / max(pos.sum(), 1), neg / max(neg.sum(), 1)))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of about ``rows`` labelled documents, chosen by a hash of the id. Labels of an id
    named more than once count as toxic if one of them does. The ids are few enough to broadcast.

    Copies would prove their words over and over, so of texts with the same smallest hash of three
    words in a row only the one with the smallest id is learned from."""
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    share = max(1, int(min(1.0, rows / max(known.count(), 1)) * (1 << 20)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < share)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn(
        "words", F.split(F.trim(F.coalesce("text", F.lit(""))), "\\s+"))
    shingle = F.transform("words", lambda w, i: F.xxhash64(
        w, F.get("words", i + 1), F.get("words", i + 2)))
    return found.withColumn("sketch", F.array_min(shingle)).groupBy("sketch").agg(
        F.min(F.struct("doc_id", "toxic", "text")).alias("kept")).select("kept.text", "kept.toxic")


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` labelled documents for which ``usable`` (over ``doc_id``) holds.

    1. Words are counted by the label of their text. The most telling ones become the landmarks
       of the Nyström map and, with the commonest and the telling words of harmless texts, the
       first cases.
    2. Two machines are fitted to the words that the first one finds in the texts, with the labels of
       the texts. One takes the worst word of each text and the words whose counts prove them. The
       other takes all words held toxic, or else the worst one; the ``k`` such words of a toxic text
       weigh ``1 / k ** 2`` each, as each of them explains less, so it holds for words that stand alone.
    3. The ``TOP`` highest margins of the one and the highest of the other are turned into a
       probability by a logistic fit: a doubtful word may stand there by chance, several do not.
    As the kernel is an inner product of subsequence weights, the sum over landmarks folds into
    one weight for each triple of symbols. Without both labels everything scores the base rate.
    """
    spark = docs.sparkSession
    sample = Scratch(spark).save(training_rows(docs, labels, usable, rows))
    symbols = spark.sparkContext.broadcast(alphabet())

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text", WORK_BYTES):
                row, which, kinds = words(part.column("text"), symbols.value)
                once = np.unique(np.stack((row, which)), axis=1) if len(row) else np.zeros((2, 0), np.int64)
                bad = part.column("toxic").to_numpy(zero_copy_only=False)[once[0]] == 1
                yield pa.RecordBatch.from_arrays(
                    [kinds.cast(pa.binary()), pa.array(np.bincount(once[1][bad], minlength=len(kinds))),
                     pa.array(np.bincount(once[1][~bad], minlength=len(kinds)))], ["word", "pos", "neg"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
    flat_model = Model(symbols.value, np.zeros((2, 1 << 15), np.float32), np.zeros(2), np.append(np.zeros(TOP + 2), np.log(rate / (1 - rate))))
    if not n_pos or not n_neg:
        return flat_model
    counted = sample.mapInArrow(count, "word binary, pos bigint, neg bigint").groupBy("word").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 1")
    both, share = F.col("pos") + F.col("neg"), n_pos / (n_pos + n_neg)
    excess = sum(2 * F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * q))).otherwise(0.0)
                 for c, q in (("pos", share), ("neg", 1 - share)))
    counted = counted.withColumn("excess", F.when(F.col("pos") > both * share, excess).otherwise(0.0))
    counted = counted.coalesce(COUNT_PARTS).persist()  # words of a bounded sample; each part sends its best to the driver
    proof = 2 * np.log(max(counted.count(), 1)) + 4
    suspects = counted.orderBy(F.desc("excess"), "word").limit(SUSPECTS).toPandas()
    common = counted.orderBy(F.desc("neg"), "word").limit(SUSPECTS).toPandas()
    other = counted.where("neg > 0").orderBy(F.xxhash64("word")).limit(4 * SUSPECTS).toPandas()
    counted.unpersist()
    proven = suspects[suspects["excess"] > proof]
    marks = list((proven if len(proven) else suspects)["word"][:LANDMARKS])
    z = subsequences(pa.array(map(bytes, marks), pa.binary()))
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])

    def machine(cases: pd.DataFrame) -> tuple[np.ndarray, float]:
        names = list(map(bytes, cases["word"]))
        x = np.vstack([subsequences(pa.array(names[i:i + 100], pa.binary())) @ z.T for i in range(0, len(names), 100)]) @ root
        which, y, weight = _balanced(cases["pos"].to_numpy(float), cases["neg"].to_numpy(float))
        w = _solve(x[which], y, weight)
        return (z.T @ (root @ w[:-1])).astype(np.float32), float(w[-1])

    least = proof if len(proven) else 0
    first = pd.concat((suspects, common, other)).assign(word=lambda d: d["word"].map(bytes)).drop_duplicates("word")
    first["pos"] = first["pos"].where(first["excess"] > least, 0)
    weights, bias = machine(first)
    model = Model(symbols.value, weights[None], np.array([bias]), flat_model.slope)
    cases = _cases(sample, model).groupBy("word").agg(*[F.sum(c).alias(c) for c in CASES]).orderBy(
        F.desc(F.col("pos") + F.col("neg")), "word").limit(rows).toPandas()
    cases["word"] = cases["word"].map(bytes)
    worst = cases[["word", "worst_pos", "worst_neg"]].set_axis(["word", "pos", "neg"], axis=1)
    kept = proven[["word", "pos", "neg"]].assign(word=proven["word"].map(bytes))
    fits = [machine(c.groupby("word").sum().reset_index()) for c in (pd.concat((worst, kept)), cases[["word", "pos", "neg"]])]
    model = Model(symbols.value, np.stack([w for w, _ in fits]), np.array([b for _, b in fits]), flat_model.slope)
    seen = _margins(sample, model).toPandas()
    x = _features(np.array(seen["best"].tolist()).reshape(-1, TOP + 1), seen["n_words"].to_numpy())
    return Model(model.symbols, model.weights, model.bias, _fit_logistic(x, seen["toxic"].to_numpy(float)))


def _over_texts(sample: DataFrame, model: Model, work, schema: str) -> DataFrame:
    # Plain arrays: a broadcast object of this module would need the module installed on the workers.
    shared = sample.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = Model(**shared.value)
        for batch in batches:
            for part in pieces(batch, "text", WORK_BYTES):
                yield work(m, part.column("text"), part.column("toxic").cast(pa.int32()))

    return sample.mapInArrow(run, schema)


def _cases(sample: DataFrame, model: Model) -> DataFrame:
    """Words with their weights as toxic and as harmless cases: of each text those with a positive
    margin, or else the worst one; and the same for the worst words alone."""
    def work(m, texts, toxic):
        row, which, margins, rank, kinds, _ = _ranked(m, texts)
        used = (margins[0] > 0) | (rank == 0)
        row, which, worst = row[used], which[used], rank[used] == 0
        bad = toxic.to_numpy(zero_copy_only=False)[row] == 1
        shared = np.bincount(row, minlength=len(texts))[row].astype(float)
        sums = [np.bincount(which, w, len(kinds)).astype(float)
                for w in (np.where(bad, shared ** -2, 0), ~bad, bad & worst, ~bad & worst)]
        return pa.RecordBatch.from_arrays([kinds.cast(pa.binary()), *map(pa.array, sums)], ["word", *CASES]).filter(
            pa.array(sums[0] + sums[1] > 0))

    return _over_texts(sample, model, work, "word binary, " + ", ".join(f"{c} double" for c in CASES))


def _margins(sample: DataFrame, model: Model) -> DataFrame:
    def work(m, texts, toxic):
        best, n = _best(m, texts)
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.list_(pa.float64())), pa.array(n), toxic],
                                          ["best", "n_words", "toxic"])

    return _over_texts(sample, model, work, "best array<double>, n_words bigint, toxic int")


def with_toxicity(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns with the probability that the whole text is toxic. Null and empty texts
    have the probability of a text without words. Nothing is shuffled."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    names, where = [*docs.columns, name], docs.columns.index(text_col)

    def run(batches):
        m = Model(**shared.value)
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in pieces(batch, str(where), WORK_BYTES):
                best, n = _best(m, part.column(where))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(best, n))], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def score_documents(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels are learned from the other folds
    only. A document without id is not held out and has no label."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held_out_fold)
    scored = with_toxicity(docs.select("doc_id", "text"), model).drop("text")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``limit``, with their columns."""
    name, = free_names(docs, "score")
    return with_toxicity(docs, model, name, text_col).where(F.col(name) < limit).drop(name)
