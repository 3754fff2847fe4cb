"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quire.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts):
    near = {w: [u for u in counts if one_edit(w, u)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda u: (-counts[u], u))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def rows(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_variants(spark, bits, monkeypatch):
    """Few letters make many neighbours, equal neighbouring letters and chains; blocks of 2, 8 and all words."""
    monkeypatch.setattr(spelling, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    counts = {"".join(rng.choice("abé😀") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 3, 4, 8, 16, 40]) for _ in range(220)}
    counts |= {"x": 1, "xx": 2, "xxx": 4, "xxxx": 8, "xxxxx": 16, "": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(spelling.spelling_variants(df)) == expected(counts)


def test_long_words(spark):
    long = "ab" * 5000
    counts = {long: 9, long + "c": 3, "c" + long: 4, long[:4000] + "x" + long[4001:]: 2, "short": 1}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    assert rows(spelling.spelling_variants(df)) == expected(counts)


def test_empty_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.count_words(docs).count() == 0


def test_blocks_make_one_trie():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(random.Random(i + 1).randint(1, 8))) for i in range(90)})
    blocks, local = [], {}
    for b in range(0, len(words), 7):
        own = words[b:b + 7]
        paths, nodes = spelling.block_nodes(own)
        local[b] = (own, paths)
        blocks.append((b, own[0], own[-1], paths[-1], nodes))
    number = {}
    for b, base, carry in spelling.joined_blocks(iter(blocks)):
        for word, path in zip(*local[b]):
            for i, x in enumerate(path):
                node = 0 if x < 0 else carry[x] if x < len(carry) else base + x
                assert number.setdefault(word[:i], node) == node
    assert len(set(number.values())) == len(number)


def test_counts(spark):
    texts = [(1, "Apples apples, APPLES! ÉCOLE École it's apples2apples"), (2, None), (3, ""), (None, "apples ÿÿÿÿÿÿ " * 40),
             (4, "a" * 100_000 + " apples"), (4, "a" * 100_000 + " apples"), (5, "a" * 100_000 + "×÷×÷×"), *[(i, "quartz wording " * 9) for i in range(90)]]
    docs = spark.createDataFrame([(i, t, "w", 7) for i, t in texts], "doc_id long, text string, word string, n long")
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    got = {r.word: r.n for r in spelling.count_words(docs, spelling.one_letter_less).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert any(w not in ("quartz", "wording", "apples") and len(w) in (5, 6) for w in got)  # some lost a letter
