"""Exact duplicates against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quire.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

ROWS = [(5, "a  b", "x"), (3, "a b", "x"), (9, "a\t\nb", "y"), (4, None, None), (8, "", "q"), (7, " ", "q"), (None, "a b", "n"),
        (2, "c", "z"), (2, "c", "z"), (None, "only", "m"), (None, "only", "m"), (1, "long " * 200_000, "l"), (6, "long\n" * 200_000, "l"),
        (10, "É", "u"), (11, "É", "u"), (12, " ", "u")]


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), text in zip(rows, norm):
        ids = [r[0] for r, n in zip(rows, norm) if n == text]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, least, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_of", [None, lambda t: F.unhex(F.substring(F.md5(t), 1, 1)), lambda t: F.lit(b"\0")])
def test_groups(spark, hash_of):
    """A hash of 4 bits, or one value for all, changes nothing: collisions are told apart by the bytes."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, id string").repartition(4)
    got = exact_duplicates(docs, **({"hash_of": hash_of} if hash_of else {})).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(ROWS)
    by_group = {}
    for r in got:
        by_group.setdefault(r.text_sha256, []).append(r)
    for rows in by_group.values():
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_kept_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, id string")
    got = sorted((tuple(r) for r in drop_exact_duplicates(docs).collect()), key=repr)
    want = sorted([(3, "a b", "x"), (4, None, None), (7, " ", "q"), (2, "c", "z"), (None, "only", "m"),
                   (1, "long " * 200_000, "l"), (10, "É", "u"), (11, "É", "u"), (12, " ", "u")], key=repr)
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
