"""Vectors: normalisation, distances as scores, and text as hashed term frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import tokens

DIM = 64


def vector_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e))
    return F.when(norm > 0, F.transform(F.arrays_zip(x.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")),
                                        lambda p: p["x"] / p["n"])).otherwise(x)


def distance_to_score(distance: Column, metric: Column) -> Column:
    """Similarity from a distance; an inner product already is one."""
    return (F.when(metric == "l2", 1 / (1 + distance)).when(metric == "ip", distance)
            .otherwise(1 - distance))


def _bag(dim: int):
    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            n = len(lists)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            buckets = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim for w in words.dictionary.to_pylist()], np.int64)
            at = np.repeat(np.arange(n) * dim, sizes) + buckets[words.indices.to_numpy(zero_copy_only=False)]
            v = np.bincount(at, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            unit = (v / np.where(norm > 0, norm, 1)).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.ravel()))
    return run


def text_embed(text: Column, dim: int = DIM) -> Column:
    """Fixed-length unit vector of a text: hashed term frequencies, one bucket per word. Words are split in the JVM; each
    different word of a batch is hashed once."""
    return _bag(dim)(tokens(text))
