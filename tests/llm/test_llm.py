"""Training-data operators against plain Python, and on odd inputs."""

import hashlib
import itertools
import os
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import (
    embed_dedup, langid, licenses, line_chunks, mixing, near_simhash, pieces, queries, resemblance, sharding, simhash,
    toxicity)
from quire.llm.tables import Scratch, components

ODD = "doc_id long, text string, source string, id string, n_chars long"
WORDS = "the quick brown fox jumps over lazy dogs while seven bright stars shine above quiet hills".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing column name."""
    long = "\n".join(prose(30, i) for i in range(300))
    rows = [(1, "a b c d e\nf g", "x", "i", 1), (2, None, None, None, None), (None, "no id here", "y", None, 1), (3, "", "x", "", 0),
            (4, long, "x", "k", 9), (5, long, None, "k", 9), (6, "same", "x", "q", 1), (6, "same", "x", "q", 1), (7, " \n\t ", "y", "q", 1),
            (8, "ÉCOLE ñandú 中文 😀 ▁", "y", "q", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups(500, real)
    assert got == {x: want[x] for x in {y for e in real for y in e}}


# 1: embeddings
def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    near = np.repeat(base, 8, 0) + rng.normal(size=(320, 24)) * rng.choice([0.05, 0.2, 0.32], (320, 1))
    vectors = [v.tolist() for v in near] + [near[0].tolist()] * 5 + [(near[1] * 3).tolist()]
    odd_ones = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], []]
    rows = list(enumerate([*vectors, *odd_ones]))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, key int")
    u = np.array(vectors)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    low = groups(len(u), np.argwhere(link))
    for block_rows in (8192, 50):
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, block_rows=block_rows).collect()}
        assert len(got) == len(rows)
        for i in range(len(u)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), low[i], low[i] == i)
        for i in range(len(u), len(rows)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


# 2: mixing
def test_mixture_is_never_a_block_away():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 6)
        weights, blocks = [rng.randint(1, 8) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        slots = {}
        for i, own in enumerate(mixing.phases(blocks, weights)):
            for p in own:
                for k in range(p["first"], p["last"] + 1):
                    j = k - p["first"]
                    slots[p["base"] + j // len(p["slots"]) * p["q"] + p["slots"][j % len(p["slots"])]] = (i, k)
        assert sorted(slots) == list(range(sum(blocks)))
        used, base, begin, live = [0] * n, [0] * n, 0, [i for i in range(n) if blocks[i]]
        for t in range(sum(blocks)):
            i, k = slots[t]
            assert k == used[i]
            used[i] += 1
            total = sum(weights[j] for j in live)
            assert all(abs(used[j] - base[j] - (t + 1 - begin) * weights[j] / total) < 1 for j in live)
            if used[i] == blocks[i]:
                live, begin, base = [j for j in live if used[j] < blocks[j]], t + 1, used[:]


def test_mixing_keeps_rows(spark, odd, empty, sf_dir):
    for docs in (odd, queries.table(spark, sf_dir, "documents")):
        rows = mixing.mix(docs, {"x": 3, None: 2, "src0": 5}, block_rows=2).collect()
        assert len(rows) == docs.count() and len({r.position for r in rows}) == len(rows)
        assert sorted({r.slot for r in rows}) == list(range(len({r.slot for r in rows})))
        per = {}
        for r in rows:
            per.setdefault((r.source, r.block), set()).add(r.slot)
        assert all(len(s) == 1 for s in per.values())
        assert sorted(map(str, mixing.mixed_order(docs, block_rows=2).collect())) == sorted(map(str, docs.collect()))
    assert mixing.mix(empty).count() == 0


# 3: language
def test_language(spark, sf_dir, odd, empty):
    docs = queries.table(spark, sf_dir, "documents")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    model = langid.train(docs, F.lit(True))
    rows = langid.identify(odd, model, reject=False).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 7)} == {2: "und", 3: "und", 7: "und"}
    assert langid.identify(odd, langid.train(docs.where("false"), F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0
    # probabilities of all symbols after a context sum to one
    symbols = np.arange(1, int(model.symbols.max()) + 1)
    code = (langid.EDGE << 12) | symbols
    assert np.allclose((2.0 ** langid.log_probabilities(model, code.astype(np.int64))).sum(0), 1, atol=0.02)


def test_huge_languages_are_drawn_from():
    assert langid.drawn(3000, 10**10) == 1 and langid.drawn(3000, 6000) == 1 << 19 and langid.drawn(3000, 0) == 1 << 20


# 4: shards
def test_permutation_and_shards(spark, odd, empty, sf_dir):
    for n in (1, 2, 3, 7, 12, 97, 1000):
        rows = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 3)).collect()]
        assert sorted(rows) == list(range(n))
        assert rows[sharding.unpermute(n // 2, n, 3, spark)] == n // 2
    for docs in (odd, queries.table(spark, sf_dir, "documents")):
        out = sharding.shard_documents(docs, 5, seed=1).collect()
        text = [((r.text or "").encode()) for r in docs.collect()]
        assert sorted((r.size, r.text_crc32) for r in out) == sorted((len(t) + 8, zlib.crc32(t)) for t in text)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(5)) <= 1
        again = sharding.shard_documents(docs.repartition(7), 5, seed=1).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.shard_documents(empty).count() == 0


def test_hot_key_is_spread(spark):
    docs = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows, n = sharding.number_rows(docs, ["doc_id", "text"])
    assert n == 25_000 and rows.agg(F.count_distinct("row_number"), F.max("row_number")).first()[:] == (n, n - 1)


# 5: fingerprints
def test_fingerprints(spark, odd, empty, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        n = len(r.text) // 3
        edited = r.text[:len(r.text) - n] + nxt.text[:n]
        own, other = got[r.doc_id], got[nxt.doc_id]
        assert (own.n_chars, own.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        like = 1 - (int(own.fingerprint, 16) ^ int(other.fingerprint, 16)).bit_count() / 64
        assert abs(own.near_next - like) < 1e-12
        assert own.edited_fingerprint == f"{int(simhash.fingerprints(pa.array([edited]))[0]):016x}"
    assert np.mean([r.near_edited - r.near_next for r in got.values()]) > 0.15
    out = simhash.fingerprint_documents(odd).collect()
    assert len(out) == odd.count() and len({r.fingerprint for r in out if r.doc_id in (4, 5)}) == 1
    assert simhash.fingerprint_documents(empty).count() == 0


@pytest.mark.parametrize("links, radius", [(simhash.near_fingerprints, 3), (None, 4)])
@pytest.mark.parametrize("block_rows", [2048, 20])
def test_near_fingerprints(spark, links, radius, block_rows, monkeypatch):
    rng = np.random.default_rng(7)
    points = set()
    for b in rng.integers(0, 2**63, 15, dtype=np.uint64).tolist():
        for _ in range(120):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            points.add(x)
    points = np.array(sorted(points), np.uint64)
    signed = points.view(np.int64).tolist()
    at = {v: i for i, v in enumerate(signed)}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    keys = simhash.block_keys if links else near_simhash.cells
    got = near_simhash.near_links(df, Scratch(spark), radius, block_rows, keys).collect()
    want = [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)]
    assert groups(len(points), [(at[a], at[b]) for a, b in got]) == groups(len(points), want)


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_search_finds_all(spark, block_rows):
    rng, points = np.random.default_rng(8), set()
    for b in rng.integers(0, 2**64, 6, dtype=np.uint64).tolist():
        for _ in range(150):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            points.add(x)
    points = np.array(sorted(points), np.uint64)
    asked = points[::3]
    frame = lambda x: spark.createDataFrame([(v,) for v in x.view(np.int64).tolist()] + [(None,)], "fp long")
    got = {r.query: r.found for r in simhash.near_fingerprints(frame(points), frame(asked), 3, block_rows).collect()}
    want = {q: sorted(points[np.bitwise_count(points ^ np.uint64(q & (2**64 - 1))) <= 3].view(np.int64).tolist())
            for q in asked.view(np.int64).tolist()}
    assert got == want and max(map(len, want.values())) > 32


def test_fingerprint_query_searches(spark, sf_dir):
    rows = queries.QUERIES["op5_fingerprints"](spark, sf_dir).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert len(rows) == len(prints) == queries.table(spark, sf_dir, "documents").count()
    for r in rows:
        if r.doc_id % 20:
            assert r.near_fingerprints is None
        else:
            near = {p for p in prints.values() if (p ^ prints[r.doc_id]).bit_count() <= 3}
            assert sorted(r.near_fingerprints) == sorted(f"{p:016x}" for p in near)


# 6: licences
def test_licenses(spark, odd, empty):
    mit = licenses.TEXTS["MIT"][1]
    wrapped = "Copyright (c) 2020 Somebody\n" + "\n".join(re.findall(r".{1,60}(?: |$)", mit.upper().replace('"', "'")))
    rows = [(1, mit), (2, wrapped), (3, mit + " more"), (4, None), (5, ""), (6, "text\nReleased under the MIT Licence!\nmore"),
            (7, "licensed under cc by nc 4 0"), (7, "licensed under cc by nc 4 0")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.notices) for r in got if r.license) == [
        (1, "MIT", "MIT"), (2, "MIT", ""), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0")]
    assert {r.doc_id: r.notices for r in got if not r.license} == {3: "", 4: "", 5: "", 6: "MIT"}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def test_full_licenses_and_titles(spark):
    body = licenses.TEXTS["MIT"][1].removeprefix("MIT License ")
    rows = [(1, body), (2, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + body), (3, "Copyright (c) 2020 A. " + body),
            (4, "Copyright (c) 2020 A. Other text.")]
    want = {1: "MIT", 2: "MIT", 3: "MIT", 4: None}
    for i, (path, name) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"),
                                      ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0")]):
        path = f"/usr/share/common-licenses/{path}"
        if os.path.exists(path):
            rows.append((10 + i, open(path).read()))
            want[10 + i] = name
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == want


# 7: pieces
@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_match_the_library(model_path, spark, sf_dir):
    import sentencepiece
    library, v = sentencepiece.SentencePieceProcessor(model_file=model_path), pieces.load_vocabulary(model_path)
    rng = random.Random(2)
    texts = ["", None, " ", "  ", "▁", " ▁ a▁", "a" * 999, "ab" * 501, "aaab" * 300, "=====-----####" * 50, "\n" * 40, "x\x00y\t z", prose(500, 1)]
    for alphabet, n in ((" \n\tabeéß▁中😀aaeett  ", 60), ("abcdefghij", 300), ("ab", 200), ("=-_.e ", 200)):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, n))) for _ in range(200)]
    texts += [r.text for r in queries.table(spark, sf_dir, "documents").select("text").collect()]
    ids, at = pieces.encode(v, pa.array(texts, pa.string()))
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    data, at = pieces.decode(v, ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == library.decode(want)
    loose = [[rng.randint(3, 258) if rng.random() < 0.5 else rng.randint(1, 31999) for _ in range(rng.randint(0, 20))] for _ in range(200)]
    data, at = pieces.decode(v, np.array(sum(loose, []), np.int32), np.cumsum([0] + [len(x) for x in loose]))
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == library.decode(loose)


def test_tokenize(model_path, odd, empty):
    rows = pieces.tokenize(odd, model_path, pieces.OUTPUTS).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    texts = {x.doc_id: x.text or "" for x in odd.collect()}
    assert all(r.decoded == texts[r.doc_id].replace("▁", " ") for r in rows if r.doc_id)
    assert pieces.tokenize(empty, model_path).count() == 0


# 8: toxicity
def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        text, bad = prose(40, i), i % 6 == 0
        rows.append((i, text + (" " + rng.choice(["idiot", "moron", "stupid"]) if bad else " fine") + " " + prose(5, -i), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = toxicity.score_documents(df.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.predicted == r.toxic for r in got) > 0.95 * len(got)
    model = toxicity.train(df.select("doc_id", "text"), labels, F.lit(True))

    def score(text):
        best, n = toxicity._best(model, pa.array([text], pa.string()))
        return float(model.score(best, n)[0])
    base = prose(20, 77)
    assert all(score(f"{base} {bad} {base}") > 0.5 for bad in ("idiot", "i-d-i-o-t", "i d i o t", "IDIOOT", "st.upid"))
    assert all(score(good) < 0.5 for good in (base, "", None))
    rows = toxicity.with_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.with_toxicity(empty, model).count() == 0
    copies = spark.range(2000, 2900).select(F.col("id").alias("doc_id"), F.lit(prose(60, 5)).alias("text"), F.lit(1).alias("toxic"))
    assert toxicity.training_rows(copies.select("doc_id", "text"), copies.select("doc_id", "toxic"), F.lit(True)).count() == 1
    assert toxicity.training_rows(empty, labels, F.lit(True)).count() == 0
    none = toxicity.train(df.select("doc_id", "text"), labels.where("toxic = 0"), F.lit(True))
    assert toxicity.reject_toxic(odd, none).count() == odd.count()


# 9: SimHash near-duplicates
def plain_print(text):
    import xxhash
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_near_duplicates(spark, sf_dir, odd, empty):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(["", None, "One", "one", "a  B\tc d", "A b C D", "\x0b \x0c", "é É"])]
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {d: (f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, groups(len(rows), pairs))}
    got = near_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)
    assert near_simhash.near_duplicates(odd).count() == odd.count()
    kept = near_simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 8]
    assert near_simhash.near_duplicates(empty).count() == near_simhash.keep_one_per_group(empty).count() == 0


def shingled(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike_pairs(texts):
    """Pairs of texts with 0.8 or more of their five-word shingles in common, found by shared shingles."""
    sets, holders, shared = [shingled(t) for t in texts], {}, Counter()
    for i, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    for held in holders.values():
        shared.update(itertools.combinations(held, 2))
    empty = [i for i, own in enumerate(sets) if not own]
    return [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)] + list(zip(empty, empty[1:]))


def test_near_duplicates_of_a_whole_table(spark):
    """All 1,000 documents of sf0.01 against exact Jaccard similarity."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    pairs = alike_pairs([t for _, t in rows])
    assert sum(rows[i][1] != rows[j][1] for i, j in pairs) >= 5
    want = sorted(rows[g][0] for g in set(groups(len(rows), pairs)))
    assert sorted(r.doc_id for r in resemblance.keep_one_per_group(docs).collect()) == want


@pytest.mark.parametrize("block", [(1024, 1 << 20), (3, 400)])
def test_edited_copies_go(spark, odd, empty, block):
    rng, texts = random.Random(9), []
    for i in range(25):
        base = prose(200, 3000 + i).split(" ")
        for _ in range(8):
            words = list(base)
            for at in rng.sample(range(200), rng.randint(0, 7)):
                words[at] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "One  two", "one three"]
    sets = [shingled(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in pairs if (plain_print(texts[i]) ^ plain_print(texts[j])).bit_count() > 4]
    assert len(far) > 50  # pairs that the four bits of op9 do not link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = resemblance.keep_one_per_group(docs, block_rows=block[0], block_shingles=block[1]).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups(len(texts), pairs)))
    kept = resemblance.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 8]
    assert resemblance.keep_one_per_group(empty).count() == 0


# 10: repeated passages
def test_line_chunks(spark, odd, empty):
    passage = prose(60, 1)
    rows = [(i, "\n".join([prose(8, 100 + i), passage, prose(8, 200 + i)])) for i in range(5)]
    rows += [(10, None), (11, ""), (12, passage), (13, f"{passage}\n{passage}"), (14, "short\nshort"), (None, passage)]
    got = {r.doc_id: r for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None].text == passage and got[None].n_removed == 0
    for i in range(5):
        assert got[i].text == "\n".join([prose(8, 100 + i), prose(8, 200 + i)]) and got[i].n_removed == 1
    assert (got[10].text, got[11].text, got[12].text, got[13].text, got[14].text) == (None, "", "", "", "short\nshort")
    out = line_chunks.drop_repeated_chunks(odd)
    assert out.columns == [*odd.columns, "n_chunks", "n_removed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and rows[4].n_removed == 0 and rows[6].text == "same"
    left = rows[5].text.split("\n")  # the copy keeps its chunks of one line with fewer than 40 words
    assert rows[5].n_chunks - rows[5].n_removed == len(left) < 150 and set(left) < set(rows[4].text.split("\n"))
    assert line_chunks.drop_repeated_chunks(empty).count() == 0


def test_passages_of_short_lines_go(spark, odd, empty):
    passage, pair = [prose(n, 50 + n) for n in (9, 25, 32, 13)], [prose(34, 60), prose(33, 61)]
    rows, want = [], {}
    for i in range(12):
        head, tail = prose(8, 100 + i), prose(9, 200 + i)
        rows += [(i, "\n".join([head, *passage, tail])), (20 + i, "\n".join([head + "x", *pair, tail + "x"]))]
        want |= {i: [head, tail], 20 + i: [head + "x", tail + "x"]}
    want[0], want[20] = rows[0][1].split("\n"), rows[1][1].split("\n")
    few = "\n".join(["few words", prose(20, 1), prose(20, 2), "and more"])
    rows += [(40, few), (41, few.replace("few", "the")), (42, None), (43, ""), (None, "\n".join(pair))]
    want |= {40: few.split("\n"), 41: few.replace("few", "the").split("\n"), 43: [""], None: pair, 20: [want[20][0], want[20][-1]]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_chunks.drop_repeated_runs(docs).collect()}
    assert got.pop(42) is None and {k: v.split("\n") for k, v in got.items()} == want
    staged = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert all(set(staged[i].split("\n")) <= set(want[i]) for i in want)
    out = line_chunks.drop_repeated_runs(odd)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == odd.columns and out.count() == odd.count() and rows[5].text == "" and rows[6].text == "same"
    assert line_chunks.drop_repeated_runs(empty).count() == 0


# the pipeline
def test_pipeline_stages(spark, sf_dir, model_path):
    scratch, docs, seen = Scratch(spark), queries.table(spark, sf_dir, "documents"), [queries.table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if name != "sentencepiece":
            assert docs.columns == seen[0].columns
        seen.append(docs)
    start, clean, cut, one, mixed, tokens = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert 0 < len(start) - len(clean) < 0.3 * len(start) and all(clean[i] == start[i] for i in clean)
    assert cut.keys() == clean.keys() and all(len(r.text) == r.n_chars for r in cut.values())
    assert all(set(cut[i].text.split("\n")) <= {*clean[i].text.split("\n"), ""} for i in cut)
    ids = sorted(cut)
    pairs = alike_pairs([cut[i].text for i in ids])
    assert one == {ids[g]: cut[ids[g]] for g in groups(len(ids), pairs)}
    assert mixed == one and tokens.keys() == one.keys()
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    assert all(r.ids == library.encode(one[i].text, add_bos=True, add_eos=True) for i, r in tokens.items())


def test_mixture_outlives_the_reread(spark, model_path):
    docs = spark.createDataFrame([(i, prose(5, i), "en", f"src{i % 4}", 9) for i in range(600)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    mixed = Scratch(spark).save(corpus_pipeline.mixture(spark, docs, "").repartition(7))
    rows = Scratch(spark).save(corpus_pipeline.tokens(spark, mixed, "")).collect()
    want = {r.doc_id: (r.slot, r.position) for r in mixing.mix(docs, queries.MIXTURE, block_rows=16, seed=20).collect()}
    assert {r.doc_id: (r.slot, r.position) for r in rows} == want and len(rows) == 600
    sources = [f"src{r.doc_id % 4}" for r in sorted(rows, key=lambda r: r.position)]
    first = sources[:11 * 16]  # a period: 4, 3, 2 and 2 blocks of 16 rows
    assert [first.count(f"src{i}") for i in range(4)] == [64, 48, 32, 32]


def test_columns_named_like_the_mixture(spark, model_path):
    """The documents' own slot and position do not pass for those of the mixture."""
    docs = spark.createDataFrame([(i, prose(5, i), "en", f"src{i % 2}", 9, 777, 888) for i in range(40)],
                                 "doc_id long, text string, lang string, source string, n_chars long, slot long, position long")
    rows = {r.doc_id: (r.slot, r.position) for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    want = mixing.mix(docs, queries.MIXTURE, block_rows=16, seed=20)
    assert rows == {r.doc_id: (r._slot, r._position) for r in want.collect()} and len(set(rows.values())) == 40
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and {(r.slot, r.position) for r in mixed.collect()} == {(777, 888)}


def test_models_travel_without_the_package(spark, sf_dir, monkeypatch):
    """What is broadcast is plain data, so that workers need nothing installed."""
    from pyspark import SparkContext
    sent, broadcast = [], SparkContext.broadcast

    def watched(self, value):
        sent.append(pickle.dumps(value))
        return broadcast(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", watched)
    for name in ("op3_langid", "op7_sentencepiece", "op8_toxicity"):
        sent.clear()
        assert queries.QUERIES[name](spark, sf_dir).count() > 0
        assert sent and not any(b"quire.llm" in s for s in sent), name


def test_fingerprints_propose_near_duplicates():
    """Sets of similarity 0.8 meet in a band and within the radius; groups of a band are those of brute force, hot bands are one."""
    rng, found = np.random.default_rng(4), 0
    bands, width = resemblance.band_shape(1000)
    for _ in range(200):
        base = rng.integers(0, 2**63, 90, dtype=np.uint64)
        both = np.concatenate([np.sort(base[:81]), np.sort(np.concatenate([base[:72], base[81:]]))])
        key, prints = resemblance._prints(both, np.array([0, 81]))
        rows = pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array([p.tobytes() for p in prints], pa.binary())], ["key", "print"])
        banded, = resemblance._banded(bands, width)([rows])
        own = [c.to_numpy() for c in banded.columns]
        order = np.lexsort((own[1], own[0]))
        met = list(resemblance._meet([pa.RecordBatch.from_arrays([pa.array(x[order]) for x in own], banded.schema.names)]))
        found += any(m.num_rows for m in met)
    assert found >= 195
    assert resemblance.band_shape(10**8) > resemblance.band_shape(10**6)

    band = np.sort(rng.integers(0, 9, 300))
    prints = rng.integers(0, 4, (300, 2)).astype(np.uint64)
    pairs = [(i, j) for i, j in itertools.combinations(range(300), 2) if band[i] == band[j]
             and sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= 1]
    assert resemblance.near_groups(band, prints, 1).tolist() == groups(300, pairs)
    for size in (7, 300, 5000):  # the bands come in batches of any size
        band = np.repeat(np.array([1, 2, 3, 4]), [3, resemblance.RUN_ROWS + 50, 1, 2])
        key = np.arange(len(band))
        zero = np.zeros(len(band), np.int64)
        batches = pa.Table.from_arrays([pa.array(x) for x in (band, key, zero, zero)], ["band", "key", "w0", "w1"]).to_batches(size)
        out = [r for b in resemblance._meet(batches) for r in zip(b.column("key").to_pylist(), b.column("hub").to_pylist())]
        last = len(band) - 2
        assert sorted(out) == [(k, 0) for k in range(3)] + [(k, 3) for k in range(3, last - 1)] + [(last, last), (last + 1, last)]


def test_no_near_duplicate_is_left_out(spark, monkeypatch):
    """Pairs of similarity 0.8 that meet in no band are found, next to rare and very frequent passages and in any order of the prefixes."""
    def pair(seed):
        rng = random.Random(seed)
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(85)]
        return " ".join(base), " ".join(base[:76] + [f"x{rng.randint(0, 10**9)}" for _ in range(9)])
    texts = [t for seed in (42, 118, 589, 709, 743, 897) for t in pair(seed)]
    hashes, at = resemblance.shingle_sets(pa.array(texts))
    key, prints = resemblance._prints(hashes, at[:-1])
    rows = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([p.tobytes() for p in prints], pa.binary())], ["key", "print"])
    banded, = resemblance._banded(*resemblance.band_shape(len(texts)))([rows])
    own = [c.to_numpy() for c in banded.columns]
    order = np.lexsort((own[1], own[0]))
    met = resemblance._meet([pa.RecordBatch.from_arrays([pa.array(x[order]) for x in own], banded.schema.names)])
    assert sum(m.num_rows for m in met) == 0
    common = prose(20, 7)
    texts += [f"{common} {prose(30, 500 + i)}" for i in range(200)]
    long = prose(100, 77).split(" ")
    monkeypatch.setattr(resemblance, "PAIR_ROWS", 64)
    texts += [" ".join(long[:i] + [f"z{i}"] + long[i + 1:]) for i in range(80)] + [" ".join(long[:90] + prose(20, 900 + i).split(" ")) for i in range(5)]
    texts += ["a b c d e f", "a b c d e g", "a b c", "A b  c"]
    sets = [shingled(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(groups(len(texts), pairs)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in resemblance.keep_one_per_group(docs).collect()) == want
    # Without any help of the fingerprints, and with shingles held to be frequent.
    monkeypatch.setattr(resemblance, "band_shape", lambda sets: (1, 60))
    assert sorted(r.doc_id for r in resemblance.keep_one_per_group(docs).collect()) == want
    monkeypatch.setattr(resemblance, "_hot", lambda slim: np.unique(resemblance.shingle_sets(pa.array(texts))[0])[::3].view(np.int64))
    assert sorted(r.doc_id for r in resemblance.keep_one_per_group(docs, block_rows=20).collect()) == want
