"""Toxicity with a long-tailed insult vocabulary, and the kernel's own features against the kernel."""

import random

import numpy as np

from lakeknit.llm import toxicity


def words(rng, n):
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_rare_insults_are_found():
    rng = random.Random(3)
    insults, vocabulary = words(rng, 60), words(rng, 3000)

    def text(*more):
        out = rng.choices(vocabulary, [1 / (i + 1) for i in range(3000)], k=60) + list(more)
        rng.shuffle(out)
        return " ".join(out)

    told = rng.choices(insults, [1 / (i + 1) for i in range(60)], k=300)
    m = toxicity.Machine([(1, text(w)) for w in told] + [(0, text()) for _ in range(600)])
    rare = [w for w in dict.fromkeys(insults) if 4 <= told.count(w) <= 10]
    assert len(rare) > 10
    assert np.mean([s >= 0.5 for s in m.scores([text(w).encode() for w in rare for _ in range(4)])]) > 0.8
    assert np.mean([s < 0.5 for s in m.scores([text().encode() for _ in range(200)])]) > 0.9


def test_features_are_kernels_with_every_landmark():
    rng = random.Random(5)
    m = toxicity.Machine([])
    marks, units = (["".join(rng.choice("abcé^$") for _ in range(rng.randint(3, 16))) for _ in range(20)] for _ in range(2))
    units += ["xyz", "ab", "aaaa"]
    m.index(marks)
    m.whiten = np.eye(len(marks), dtype=np.float32)
    s = toxicity._codes(units)
    for k, mark in enumerate(marks):
        t = np.array([ord(c) for c in mark], dtype=np.uint32)
        want = toxicity.kernel(s, t) / np.sqrt(np.maximum(toxicity.self_kernel(s), 1e-12) * toxicity.kernel(t[None, :], t)[0])
        assert np.allclose(m.features(units)[:, k], want, atol=1e-4)


def test_scores_are_the_landmarks_kernels():
    """A unit's score is the machine's sum over landmarks of normalised kernels, each counted subsequence by subsequence."""
    from itertools import combinations

    def force(s, t):
        at = lambda x: [("".join(x[k] for k in i), toxicity.DECAY ** (i[-1] - i[0] + 1)) for i in combinations(range(len(x)), toxicity.ORDER)]
        return sum(a * b for x, a in at(s) for y, b in at(t) if x == y)

    rng = random.Random(11)
    told = [(1, " ".join(words(rng, 12)) + " grumbus") for _ in range(15)] + [(0, " ".join(words(rng, 12))) for _ in range(30)]
    m = toxicity.Machine(told, landmarks=20)
    for u in ("^grumbus$", "^grum.bus$", "^gra$", "^babebi$", "xy"):
        want = sum(a * force(u, k) / np.sqrt(force(u, u) * force(k, k)) for a, k in zip(m.alpha, m.marks, strict=True)) if len(u) >= toxicity.ORDER else 0.0
        assert abs(m.units_scores([u])[0] - want - m.bias) < 2e-3, u
    assert m.units_scores(["^grumbus$"])[0] > 0.5
    assert m.scores([b"a grumbus here"])[0] > m.scores([b"a bridge here"])[0]
