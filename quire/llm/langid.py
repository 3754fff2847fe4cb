"""Language identification by character language models with interpolated Kneser-Ney smoothing."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.flat import distinct, flat, pieces, spans_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, BITS = 5, 12
TRAIN_ROWS = 3000
RARE, EDGE, FIRST = 1, 2, 3
UNKNOWN = "und"
KEPT = 0.999


@dataclass
class Model:
    """Per order the n-grams of all languages as ascending codes with one log2 probability per
    language, and their contexts with the log2 weight of the next lower order.

    An n-gram's code packs its symbols into 12 bits each, so codes are hashes without collisions.
    """
    languages: list[str]
    symbols: np.ndarray
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray
    scale: float
    limits: np.ndarray


def letters_table(chars: list[int]) -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, its own for the given lower-case letters,
    one for all other letters."""
    own = {c: i + FIRST for i, c in enumerate(chars)}
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = own.get(ord(c.lower()[0]), RARE)
    return out


def words(texts: pa.Array, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, which, kinds)`` of all runs of letters, as 16-bit symbols."""
    data, starts = flat(texts)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[starts]
    sym = np.insert(symbols[cp], begins[1:], 0)
    row_at = begins + np.arange(len(begins))
    begin, end = spans_of(sym > 0)
    row = np.searchsorted(row_at, begin, side="right") - 1
    offset = np.concatenate(([0], np.cumsum(end - begin)))
    own = sym[sym > 0]
    which, kinds = distinct(pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(offset * 2), pa.py_buffer(own)]))
    return row, which, kinds


def codes(kinds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of highest order that ends at each letter and at the edge behind each word, and
    its word. What lies before the edge in front of the word is symbol 0."""
    at = np.frombuffer(kinds.buffers()[1], np.int64)[:len(kinds) + 1] // 2
    sym = np.frombuffer(kinds.buffers()[2] or b"", np.uint16)
    length = np.diff(at) + 2
    offset = np.concatenate(([0], np.cumsum(length)))
    word = np.repeat(np.arange(len(kinds)), length)
    out = np.full(offset[-1], EDGE, np.int64)
    inner = np.ones(len(out), bool)
    inner[offset[:-1]] = inner[offset[1:] - 1] = False
    out[inner] = sym
    place = np.arange(len(out)) - offset[:-1][word]
    code = out.copy()
    for back in range(1, ORDER):
        ok = place >= back
        code[ok] |= out[np.flatnonzero(ok) - back] << (BITS * back)
    own = place > 0
    return code[own], word[own]


def fit(counts: list[np.ndarray], grams: np.ndarray, vocabulary: int) -> tuple:
    """Tables from the counts of the highest order (one column per language). Lower orders count
    in how many ways an n-gram is continued to the left; every order has one discount per language,
    and keeps what it takes off for the next lower order."""
    by_order = {ORDER: (grams, counts)}
    for n in range(ORDER - 1, 0, -1):
        codes_, c = by_order[n + 1]
        low, where = np.unique(codes_ & ((1 << (BITS * n)) - 1), return_inverse=True)
        ways = np.zeros((len(low), c.shape[1]))
        np.add.at(ways, where, c > 0)
        by_order[n] = (low, ways)
    floor = np.full(counts.shape[1], 1.0 / vocabulary)
    grams_out, logs, contexts, backs = [], [], [], []
    lower = None
    for n in range(1, ORDER + 1):
        codes_, c = by_order[n]
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        context, where = np.unique(codes_ >> BITS, return_inverse=True)
        total, kinds = np.zeros((len(context), c.shape[1])), np.zeros((len(context), c.shape[1]))
        np.add.at(total, where, c)
        np.add.at(kinds, where, c > 0)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = floor if n == 1 else lower[np.searchsorted(by_order[n - 1][0], codes_ & ((1 << (BITS * (n - 1))) - 1))]
        p = np.where(total[where] > 0, np.maximum(c - discount, 0) / np.maximum(total[where], 1), 0) + back[where] * below
        grams_out.append(codes_)
        logs.append(np.log2(np.maximum(p, 1e-12)).astype(np.float32))
        contexts.append(context)
        backs.append(np.log2(np.maximum(back, 1e-12)).astype(np.float32))
        lower = p
    return grams_out, logs, contexts, backs, np.log2(floor)


def _found(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, code), len(table) - 1)
    return at, table[at] == code


def log_probabilities(model: Model, code: np.ndarray) -> np.ndarray:
    """One row of log2 probabilities per n-gram: of the highest order that knows it, after the
    weights of the contexts passed on the way down."""
    out = np.zeros((len(code), len(model.languages)), np.float32)
    rest = np.arange(len(code))
    for n in range(ORDER, 0, -1):
        own = code[rest] & ((1 << (BITS * n)) - 1)
        at, known = _found(model.grams[n - 1], own)
        out[rest[known]] += model.logs[n - 1][at[known]]
        rest, own = rest[~known], own[~known]
        if not len(rest):
            return out
        at, known = _found(model.contexts[n - 1], own >> BITS)
        out[rest[known]] += model.backs[n - 1][at[known]]
    out[rest] += model.floor
    return out


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text under each language, and the number of symbols."""
    row, which, kinds = words(texts, model.symbols)
    n = len(texts)
    if not len(row):
        return np.zeros((n, len(model.languages))), np.zeros(n)
    code, word = codes(kinds)
    log = log_probabilities(model, code)
    size = np.bincount(word, minlength=len(kinds))
    length = np.bincount(row, size[which], n)
    total = np.empty((n, len(model.languages)))
    for k in range(len(model.languages)):
        total[:, k] = np.bincount(row, np.bincount(word, log[:, k], len(kinds))[which], n)
    return -total / np.maximum(length, 1)[:, None], length


def _shares(model_scale: float, entropy: np.ndarray, length: np.ndarray) -> np.ndarray:
    z = -entropy * (model_scale * np.sqrt(length))[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def drawn(rows: int, of: int) -> int:
    """How many of 2 ** 20 hash values are drawn for about ``rows`` rows; one at least, however many there are."""
    return max(1, int(min(1.0, rows / max(of, 1)) * (1 << 20)))


def train(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on about ``rows`` whole documents of each language, chosen by a hash, for which ``usable``
    holds and ``lang`` is not null. Every eighth of them is kept back: it fixes the scale of the
    scores, and per language the cross-entropy beyond which a text is rejected (that of all but a
    thousandth of its own texts). None if there is no such document."""
    spark = docs.sparkSession
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(per)
    if not languages:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, drawn(rows, per[k]))])
    sample = known.where(draw < share[F.col("lang")]).select("text", "lang", (F.pmod(
        F.xxhash64("text", F.lit("kept back")), F.lit(8)) == 0).alias("kept"))
    raw = spark.sparkContext.broadcast(languages)

    def count_chars(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text = flat(part.column("text"))[0].tobytes().decode().lower()
                cp, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cp.astype(np.int64)), pa.array(n)], ["cp", "n"])

    fitted = sample.where("not kept")
    chars = fitted.mapInArrow(count_chars, "cp bigint, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))
    chars = chars.orderBy(F.desc("n"), "cp").limit((1 << BITS) - FIRST - 1).collect()
    symbols = letters_table([r["cp"] for r in chars if chr(r["cp"]).isalpha()])
    shared = spark.sparkContext.broadcast(symbols)

    def count_grams(batches):
        order = {k: i for i, k in enumerate(raw.value)}
        for batch in batches:
            for part in pieces(batch, "text"):
                lang = np.array([order[x] for x in part.column("lang").to_pylist()])
                row, which, kinds = words(part.column("text"), shared.value)
                code, word = codes(kinds)
                for k in np.unique(lang):
                    times = np.bincount(which[lang[row] == k], minlength=len(kinds))[word]
                    own, at = np.unique(code[times > 0], return_inverse=True)
                    n = np.bincount(at, times[times > 0], len(own)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), k, np.int32)), pa.array(own), pa.array(n)], ["lang", "code", "n"])

    counted = fitted.mapInArrow(count_grams, "lang int, code bigint, n bigint").groupBy("lang", "code").agg(
        F.sum("n").alias("n")).toPandas()
    grams, where = np.unique(counted["code"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(grams), len(languages)))
    counts[where, counted["lang"].to_numpy()] = counted["n"]
    if not len(grams):
        return None
    model = Model(languages, symbols, *fit(counts, grams, len(chars) + FIRST), 1.0, np.full(len(languages), np.inf))
    # Plain arrays: a broadcast object of this module would need the module installed on the workers.
    shown = spark.sparkContext.broadcast(vars(model))

    def measure(batches):
        order, m = {k: i for i, k in enumerate(raw.value)}, Model(**shown.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                e, n = entropies(m, part.column("text"))
                lang = [order[x] for x in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.int32()), pa.array(e.tolist(), pa.list_(pa.float64())), pa.array(n)],
                    ["lang", "entropy", "size"])

    seen = sample.where("kept").mapInArrow(measure, "lang int, entropy array<double>, size double").where(
        "size > 0").toPandas()
    if len(seen):
        e, n, y = np.array(seen["entropy"].tolist()), seen["size"].to_numpy(), seen["lang"].to_numpy()
        scales = 2.0 ** np.arange(-4, 5, 0.5)
        loss = []
        for s in scales:  # a thousandth of doubt keeps the scale bounded where every text is right
            log = np.log(np.maximum(_shares(s, e, n), 1e-12))
            loss.append(-(0.999 * log[np.arange(len(y)), y] + 0.001 * log.mean(1)).mean())
        model.scale = float(scales[int(np.argmin(loss))])
        for k in range(len(languages)):
            own = e[y == k, k]
            if len(own):
                model.limits[k] = np.quantile(own, KEPT) + own.std()
    return model


def identify(docs: DataFrame, model: Model | None, reject: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, entropy, rejected`` of every row.

    The language is that of the lowest cross-entropy per symbol (the first in order on a tie) and
    the score its calibrated share. ``und`` with score 0 stands where the text is null or has no
    letter, and with ``reject`` also where the text is too unlike its language. Other columns are
    left behind. Nothing is shuffled.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        m = shared.value and Model(**shared.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                if m is None:
                    lang, score, own, out = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
                else:
                    e, size = entropies(m, part.column("text"))
                    best = e.argmin(1)
                    some = size > 0
                    own = e[np.arange(n), best]
                    out = some & (own > m.limits[best])
                    shown = some & ~out if reject else some
                    score = np.where(shown, _shares(m.scale, e, size)[np.arange(n), best], 0.0)
                    lang = [m.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), shown.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(own), pa.array(out)],
                    ["id", "lang_pred", "score", "entropy", "rejected"])

    out = slim.mapInArrow(run, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def predict_languages(docs: DataFrame, held_out_fold: int = 1, folds: int = 3, rows: int = TRAIN_ROWS) -> DataFrame:
    """Languages of all documents, learned from those of the other folds of ``doc_id``. A document
    without id is not held out and not learned from. Unlikely texts keep their nearest language
    and are marked ``rejected``."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    out = identify(docs.select("doc_id", "text"), train(docs, part != held_out_fold, rows), reject=False)
    return out.select("doc_id", F.coalesce(part == held_out_fold, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "entropy", "rejected")
