"""Kernels and fingerprints against plain enumerations."""

import itertools
import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa

from quire.llm import langid, simhash, toxicity

MASK = (1 << 64) - 1


def gapped_triples(word):
    """Every choice of three places at most nine apart, gaps (0) left out: weight by span, and the norm of all choices."""
    weights, square = Counter(), 0.0
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i <= toxicity.SPAN and word[i] and word[j] and word[k]:
            w = toxicity.DECAY ** (k - i + 1)
            weights[word[i] << 10 | word[j] << 5 | word[k]] += w
            square += w * w
    return weights, math.sqrt(max(square, 1e-12))


def test_subsequence_kernel():
    rng = random.Random(2)
    kinds = [bytes([30, *(rng.choice([0, 1, 2, 2, 5, 27, 28]) for _ in range(rng.randint(0, 14))), 31]) for _ in range(60)]
    kinds += [b"\x01\x02\x03", b"\x01\x02", b"\x01" * 12, b"\x00\x00\x01"]
    got = toxicity.subsequences(pa.array(kinds, pa.binary()))
    for row, word in zip(got, kinds):
        weights, norm = gapped_triples(word)
        want = np.zeros(1 << 15)
        for code, w in weights.items():
            want[code] = w / norm
        assert np.allclose(row, want, atol=1e-12)
    machine = np.random.default_rng(1).normal(size=(2, 1 << 15)).astype(np.float32)
    code = np.arange(1 << 15)
    machine[:, (code >> 10 == 0) | (code >> 5 & 31 == 0) | (code & 31 == 0)] = 0  # no landmark holds a gap
    assert np.allclose(toxicity.word_margins(pa.array(kinds, pa.binary()), machine), machine @ got.T, atol=1e-4)


def test_inserted_characters_stay_near():
    """The kernel of a word and the same word with gaps or a letter more is high, that of another word low."""
    symbols = toxicity.alphabet()
    row, which, kinds = toxicity.words(pa.array(["stupid", "s.t.u.p.i.d", "stuupid", "garden"]), symbols)
    x = toxicity.subsequences(kinds.cast(pa.binary()))[which[np.argsort(row)]]
    near = x @ x.T
    assert min(near[0, 1], near[0, 2]) > 0.5 and near[0, 3] < 0.2


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_simhash(text):
    def word_hash(word):
        return mix(sum((b + 1) * pow(simhash.BASE, i, 1 << 64) for i, b in enumerate(word.encode())) & MASK)
    words = [word_hash(re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    counts = Counter([mix((a * 3 + b) & MASK) for a, b in zip(words, words[1:])] or words)
    votes = [0] * 64
    for term, n in counts.items():
        weight = round(8 * (1 + math.log(n)))
        for bit in range(64):
            votes[bit] += weight if term >> bit & 1 else -weight
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def test_simhash():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "Quick", "É", "中文", "fox", "a", "b\tc", "x\ny"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " ", "one", "ONE", "one one", "long " * 5000, "A B c"]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [plain_simhash(t) for t in texts]


def plain_kneser_ney(words, vocabulary):
    """Interpolated Kneser-Ney of one language: probability of the last symbol of a tuple after the others."""
    counts = {langid.ORDER: Counter()}
    for word in words:
        for i in range(1, len(word)):
            counts[langid.ORDER][tuple(([0] * langid.ORDER + word[:i + 1])[-langid.ORDER:])] += 1
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # in how many ways it is continued to the left
    discount = {}
    for n, c in counts.items():
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once else 0.5

    @cache
    def probability(gram):
        n = len(gram)
        if not n:
            return 1 / vocabulary
        after = [c for g, c in counts[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return probability(gram[1:])
        kept = max(counts[n][gram] - discount[n], 0) / sum(after)
        return kept + discount[n] * len(after) / sum(after) * probability(gram[1:])
    return probability


def test_kneser_ney():
    """Two languages over one set of n-grams, each against a model of its own; known and unknown n-grams."""
    rng, edge, first = random.Random(4), langid.EDGE, langid.FIRST
    texts = [[[edge, *(first + rng.choice(letters) for _ in range(rng.randint(1, 7))), edge] for _ in range(80)]
             for letters in ((0, 0, 0, 1, 2), (0, 1, 3, 3, 4))]
    tuples = {}
    for k, words in enumerate(texts):
        for word in words:
            for i in range(1, len(word)):
                gram = tuple(([0] * langid.ORDER + word[:i + 1])[-langid.ORDER:])
                tuples.setdefault(gram, [0, 0])[k] += 1
    pack = lambda gram: sum(x << (langid.BITS * i) for i, x in enumerate(reversed(gram)))
    order = sorted(tuples, key=pack)
    vocabulary = 9
    model = langid.Model(["a", "b"], np.zeros(1), *langid.fit(np.array([tuples[g] for g in order], float), np.array([pack(g) for g in order]), vocabulary),
                         1.0, np.zeros(2))
    asked = order + [tuple(rng.choice([edge, *range(first, first + 6)]) for _ in range(langid.ORDER)) for _ in range(200)]
    got = 2.0 ** langid.log_probabilities(model, np.array([pack(g) for g in asked]))
    for k, words in enumerate(texts):
        plain = plain_kneser_ney(words, vocabulary)
        assert np.allclose(got[:, k], [plain(g) for g in asked], rtol=1e-4)
