"""SentencePiece encoding and decoding in vectorised merge rounds."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from quire.llm.flat import distinct, flat, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = 0x2581
NO_PAIR = np.int32(2**31 - 1)
WORK_BYTES = 8 << 20


@dataclass
class Vocabulary:
    """What encoding and decoding need, sized by the vocabulary alone."""
    size: int
    bos: int
    eos: int
    char_id: np.ndarray      # by code point: piece id, or size + code point where there is none
    byte_id: np.ndarray      # by byte value
    pair_key: np.ndarray     # left * size + right, ascending
    pair_rank: np.ndarray
    pair_id: np.ndarray
    text: np.ndarray         # bytes of all pieces as they decode, one after another
    text_start: np.ndarray
    opens_blank: np.ndarray  # pieces that begin with a blank
    is_byte: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Tables of a BPE model with byte fallback, a dummy prefix and no text normalisation; others
    are refused. Two pieces meet at the rank of the piece they form; equal scores share a rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    bytes_at = [i for i in range(n) if model.is_byte(i)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)} | set(bytes_at)
    normal = {names[i]: i for i in range(n) if i not in special}
    if model.normalize(" ﬁ  x ") != "▁▁ﬁ▁▁x▁":
        raise ValueError("only models without text normalisation and with a dummy prefix")
    if len(bytes_at) != 256 or any(model.is_unused(i) for i in range(n)):
        raise ValueError("only models with byte fallback and without unused pieces")
    if any("▁" in p.lstrip("▁") for p in normal):
        raise ValueError("only models whose pieces have blanks at their beginning alone")
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.unique(-scores, return_inverse=True)[1]
    pairs = {normal[p[:k]] * n + normal[p[k:]]: i for p, i in normal.items()
             for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
    keys = np.array(sorted(pairs), np.int64)
    ids = np.array([pairs[k] for k in keys.tolist()], np.int32)
    char_id = np.arange(0x110000, dtype=np.int32) + n
    for p, i in normal.items():
        if len(p) == 1:
            char_id[ord(p)] = i
    byte_id = np.array(bytes_at, np.int32)
    shown = [b"" if i in special else names[i].replace("▁", " ").encode() for i in range(n)]
    for value, i in enumerate(bytes_at):
        shown[i] = bytes([value])
    return Vocabulary(
        n, model.bos_id(), model.eos_id(), char_id, byte_id, keys, rank[ids].astype(np.int32), ids,
        np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0] + [len(s) for s in shown]),
        np.array([i not in special and names[i].startswith("▁") for i in range(n)]),
        np.isin(np.arange(n), bytes_at))


def _look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of each pair."""
    key = np.where((left < v.size) & (right < v.size), left.astype(np.int64) * v.size + right, -1)
    at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
    found = v.pair_key[at] == key
    return np.where(found, v.pair_rank[at], NO_PAIR), np.where(found, v.pair_id[at], -1)


def merge(v: Vocabulary, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges of all words side by side; ``sym`` holds their characters, ``starts`` the word starts
    and the end.

    A round takes each word's smallest pair rank and merges its occurrences from the left, those
    that do not overlap. That equals one merge at a time, always the leftmost of the smallest
    rank, unless a merge makes a pair that would come first; such a word merges only its leftmost
    occurrence in this round. Words without a pair leave the arrays.
    """
    n_words = len(starts) - 1
    done_sym, done_word = [], []
    word = np.repeat(np.arange(n_words), np.diff(starts))
    rank = np.full(len(sym), NO_PAIR)
    into = np.full(len(sym), -1)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], into[inner] = _look_up(v, sym[inner], sym[inner + 1])
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        length = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        over = least == NO_PAIR
        if over.any():
            out = np.repeat(over, length)
            done_sym.append(sym[out])
            done_word.append(word[out])
            sym, word, rank, into = sym[~out], word[~out], rank[~out], into[~out]
            length, least = length[~over], least[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, length))
        new_run = np.concatenate(([True], np.diff(hit) != 1))
        run_start = np.maximum.accumulate(np.where(new_run, hit, 0))
        p = hit[(hit - run_start) % 2 == 0]
        p = _only_safe(v, sym, word, rank, into, p)
        sym[p] = into[p]
        keep = np.ones(len(sym), bool)
        keep[p + 1] = False
        at = (np.cumsum(keep) - 1)[p]
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        touched = np.unique(np.concatenate((at, at[at > 0] - 1)))
        rank[touched], into[touched] = NO_PAIR, -1
        touched = touched[touched + 1 < len(sym)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched], into[touched] = _look_up(v, sym[touched], sym[touched + 1])
    sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return sym[order], np.searchsorted(word[order], np.arange(n_words + 1))


def _only_safe(v, sym, word, rank, into, p):
    own = word[p]
    several = np.flatnonzero((np.diff(own, prepend=-1) == 0) | (np.diff(own, append=-1) == 0))
    if not len(several):
        return p
    q = p[several]
    made, least = into[q], rank[q]
    bad = np.zeros(len(q), bool)
    right = np.flatnonzero((q + 2 < len(sym)) & (word[np.minimum(q + 2, len(sym) - 1)] == word[q]))
    bad[right] |= _look_up(v, made[right], sym[q[right] + 2])[0] <= least[right]
    left = np.flatnonzero((q > 0) & (word[q - 1] == word[q]))
    bad[left] |= _look_up(v, sym[q[left] - 1], made[left])[0] <= least[left]
    joined = np.flatnonzero(np.diff(q) == 2) + 1
    joined = joined[word[q[joined - 1]] == word[q[joined]]]
    bad[joined] |= _look_up(v, made[joined - 1], made[joined])[0] <= least[joined]
    if not bad.any():
        return p
    unsafe = np.isin(own, word[q[bad]])
    return p[~unsafe | (np.diff(own, prepend=-1) != 0)]


def _gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after another, and where each begins."""
    length = (starts[1:] - starts[:-1])[which]
    offset = np.concatenate(([0], np.cumsum(length)))
    return values[np.repeat(starts[:-1][which] - offset[:-1], length) + np.arange(offset[-1])], offset


def _utf8_ids(v: Vocabulary, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the pieces of their UTF-8 bytes."""
    missing = np.flatnonzero(sym >= v.size)
    if not len(missing):
        return sym, starts
    cp = sym[missing] - v.size
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    size = np.ones(len(sym), np.int64)
    size[missing] = width
    offset = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(sym, size)
    raw = np.frombuffer("".join(map(chr, cp.tolist())).encode(), np.uint8)
    slots = np.repeat(offset[missing] - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(len(raw))
    out[slots] = v.byte_id[raw]
    return out, offset[starts]


def encode(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with begin and end ids, one after another, and where each text begins."""
    data, starts = flat(texts)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[starts]
    filled = np.flatnonzero(np.diff(begins))
    cp = np.insert(np.where(cp == 0x20, np.uint32(BLANK), cp), begins[:-1][filled], BLANK)
    row_at = begins[:-1][filled] + np.arange(len(filled))
    opens = cp == BLANK
    opens[1:] &= cp[:-1] != BLANK
    opens[row_at] = True
    word_at = np.append(np.flatnonzero(opens), len(cp))
    words = pa.Array.from_buffers(pa.large_binary(), len(word_at) - 1,
                                  [None, pa.py_buffer(word_at * 4), pa.py_buffer(np.ascontiguousarray(cp))])
    which, kinds = distinct(words)
    kind_starts = np.frombuffer(kinds.buffers()[1], np.int64)[:len(kinds) + 1] // 4
    chars = np.frombuffer(kinds.buffers()[2] or b"", np.uint32)
    ids, id_starts = _utf8_ids(v, *merge(v, v.char_id[chars].astype(np.int64), kind_starts))
    tokens, word_first = _gather(ids, id_starts, which)
    per_row = np.zeros(len(texts) + 1, np.int64)
    row_words = np.searchsorted(word_at[:-1], np.append(row_at, len(cp)))
    per_row[1:][filled] = word_first[row_words[1:]] - word_first[row_words[:-1]]
    ends = np.cumsum(per_row)
    offsets = ends + 2 * np.arange(len(texts) + 1)
    out = np.empty(offsets[-1], np.int32)
    own = np.ones(len(out), bool)
    own[offsets[:-1]] = own[offsets[1:] - 1] = False
    out[own] = tokens
    out[offsets[:-1]], out[offsets[1:] - 1] = v.bos, v.eos
    return out, offsets


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins. The blank before the first piece is the
    dummy prefix and goes; bytes that are no UTF-8 become replacement characters, one for each."""
    data, piece_at = _gather(v.text, v.text_start, ids)
    starts = piece_at[offsets]
    shown = np.flatnonzero(np.diff(piece_at))
    first = np.searchsorted(shown, offsets[:-1])
    first = shown[np.minimum(first, len(shown) - 1)] if len(shown) else np.zeros(0, np.int64)
    if len(first):
        prefix = (first >= offsets[:-1]) & (first < offsets[1:]) & v.opens_blank[ids[np.minimum(first, len(ids) - 1)]]
        keep = np.ones(len(data), bool)
        keep[piece_at[first[prefix]]] = False
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        data = data[keep]
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        texts = [_repaired(data[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
        starts = np.cumsum([0] + [len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
    return data, starts


def _repaired(raw: bytes) -> bytes:
    out = []
    while raw:
        try:
            raw.decode()
            return b"".join(out) + raw
        except UnicodeDecodeError as wrong:
            out += [raw[:wrong.start], "�".encode()]
            raw = raw[wrong.start + 1:]
    return b"".join(out)


def _digests(data: np.ndarray, starts: np.ndarray) -> list[str]:
    view, starts = memoryview(np.ascontiguousarray(data)).cast("B"), (starts * data.itemsize).tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts[:-1], starts[1:])]


OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(),
           "decoded": pa.string(), "decoded_sha256": pa.string()}
SPARK_TYPES = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def tokenize(docs: DataFrame, model_path: str, outputs: Iterable[str] = ("n_tokens", "ids"), id_col: str = "doc_id",
             text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and the chosen ``outputs`` of every row: ``n_tokens``, ``ids``, ``ids_sha256`` (ids as
    little-endian 32-bit integers), ``decoded`` (the text that the ids decode to) and its digest.

    A null text counts as empty and has the begin and end ids alone; other columns are left
    behind. Texts are worked on in slices of bounded size, within which equal words are encoded
    once; a longer text is a slice by itself. Nothing is shuffled.
    """
    outputs, keep = tuple(outputs), tuple(keep)
    # Plain arrays: a broadcast object of this module would need the module installed on the workers.
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(load_vocabulary(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**vocabulary.value)
        for batch in batches:
            for part in pieces(batch, "text", WORK_BYTES):
                ids, offsets = encode(v, part.column("text"))
                made = {"n_tokens": lambda: pa.array(np.diff(offsets)),
                        "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                        "ids_sha256": lambda: pa.array(_digests(ids, offsets), pa.string())}
                if any(o.startswith("decoded") for o in outputs):
                    data, starts = decode(v, ids, offsets)
                    made |= {"decoded_sha256": lambda: pa.array(_digests(data, starts), pa.string()),
                             "decoded": lambda: pa.Array.from_buffers(
                                 pa.large_string(), part.num_rows,
                                 [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())}
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[part.column(c) for c in keep], *[made[o]() for o in outputs]], ["id", *keep, *outputs])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("id", *keep)}
    out = slim.mapInArrow(run, ", ".join([*[f"{c} {kind}" for c, kind in kinds.items()], *[f"{o} {SPARK_TYPES[o]}" for o in outputs]]))
    return out.withColumnRenamed("id", id_col)
