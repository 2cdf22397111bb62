"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_sample, map_documents

#: The kernel: common subsequences of ORDER characters, each spanned character weighing DECAY.
ORDER = 3
DECAY = 0.5
#: Units longer than WIDTH are cut into overlapping ones; STEM is the length of a word's beginning that also counts.
WIDTH = 16
STEM = 6
#: Landmarks, at most, of the training sentences' units: half the most telling, each FRESH (a share) of what those before span, half of POOL drawn by chance, each adding most.
LANDMARKS, POOL, ADDED, FRESH = 400, 2000, 0.02, 0.3
#: A telling unit is so many times as frequent in toxic texts, and counts as if one in 1 / LEAST of them had it, at least.
PURE, LEAST = 4, 0.05
#: Units that one or two training texts have are many: so many of them, drawn by chance, stand for all.
RARE = 12_000
#: Ridge of the machine, highest scores of a text that count, and the scores from which a unit is sure or suspect.
RIDGE = 2e-3
TOP = 3
SURE, SUSPECT = 0.6, 0.3
#: A harmless text that is called toxic costs so many toxic ones that are missed.
CLEAN = 3
TRAIN_PER_CLASS = 800
#: Scores that a worker remembers, twice.
FLOOR = -1.0
CACHE_UNITS = 200_000
CHUNK = 256
_SPACED = re.compile(r"(?<!\S)\w(?:[\s._*\-]{1,3}\w(?!\w)){2,}")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_\d]+")


def word_units(token: str) -> list[str]:
    """What the kernel compares of a token in lower case: the bounded word, also without inserted marks, and its beginning."""
    word = _EDGES.sub("", token)
    if not word:
        return []
    out = []
    for w in dict.fromkeys([word, _INNER.sub("", word)]):
        if not w:
            continue
        full = f"^{w}$"
        out += [full] if len(full) <= WIDTH else [full[i : i + WIDTH] for i in range(0, len(full) - WIDTH // 2, WIDTH // 2)]
        if len(w) > STEM:
            out.append(f"^{w[:STEM]}")
    return out


def tokens(text: str) -> set[str]:
    """The distinct tokens of a whole text in lower case; single characters set apart count as one token together."""
    low = text.lower()
    return {*low.split(), *(re.sub(r"[\W_]+", "", m) for m in _SPACED.findall(low))}


def _codes(units: list[str]) -> np.ndarray:
    return np.array(units, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(units), WIDTH)


def _decays(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.where(i[None, :] >= i[:, None], DECAY ** np.abs(i[None, :] - i[:, None]).astype(float), 0).astype(np.float32)


def _dynamic(equal: Callable[[int], np.ndarray], shape: tuple[int, int], length: int) -> np.ndarray:
    """K of each row by the usual recursion; equal(a): where character a equals each character of the other string."""
    w, m = shape
    spread = _decays(m)
    before = [np.ones((w, m), np.float32)] + [np.zeros((w, m), np.float32) for _ in range(ORDER - 1)]  # K' of the prefixes, shifted by one
    total = np.zeros(w, np.float32)
    for a in range(length):
        hit = equal(a)
        total += (hit * before[ORDER - 1]).sum(1) * DECAY**2
        for i in range(ORDER - 1, 0, -1):
            # K'_i at b takes what ended at b or before; the next character may match from b + 1 on.
            inner = (hit * before[i - 1]) @ spread * DECAY**2
            before[i] *= DECAY
            before[i][:, 1:] += inner[:, :-1]
    return total


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of each row of ``s`` with the one string ``t`` (codes without padding)."""
    return _dynamic(lambda a: (s[:, a : a + 1] == t[None, :]).astype(np.float32), (len(s), len(t)), s.shape[1])


def self_kernel(s: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    there = s != 0
    return _dynamic(lambda a: ((s[:, a : a + 1] == s) & there).astype(np.float32), s.shape, s.shape[1])


def surprise(k: int, n: int, share: float) -> float:
    """Chernoff's bound on the chance of k of n or more, each of this share, as minus its logarithm."""
    p = k / n
    return n * ((p * math.log(p / share) if p else 0.0) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The positions of all subsequences of ORDER characters of a string of n, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), dtype=np.intp).reshape(-1, ORDER)
    return at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] + 1.0)).astype(np.float32)


def diverse(units: list[str], most: int, base: list[str], added: float | None = None) -> list[str]:
    """Up to ``most`` of the units that ``base`` and those before them don't span (a Cholesky factor, built column by column).

    The next one is the least spanned; with ``added``, the first in order of which at least that share is new.
    """
    every = base + units
    s = _codes(every)
    norm = np.sqrt(np.maximum(self_kernel(s), 1e-12))
    rest, factor, out = np.where(norm > 1e-5, 1.0, 0.0), np.zeros((0, len(every))), []
    for n in range(len(base) + most):
        own = rest[len(base) :]
        if n < len(base):
            k = n
        elif added is not None and (own >= added).any():
            k = len(base) + int(np.argmax(own >= added))
        elif added is None and len(own) and own.max() >= ADDED:
            k = len(base) + int(np.argmax(own))
        else:
            break
        column = kernel(s, np.array([ord(c) for c in every[k]], dtype=np.uint32)) / (norm * norm[k])
        if rest[k] > 1e-6:
            new = (column - factor[:, k] @ factor) / math.sqrt(rest[k])
            factor, rest = np.vstack([factor, new]), np.maximum(rest - new**2, 0)
        rest[k] = 0.0
        out += [every[k]] if n >= len(base) else []
    return out


def telling(bad: list[set], good: list[set]) -> list[str]:
    """Units that tell toxic texts, the surest first: chance would hardly give them to so many toxic texts and so few harmless ones.

    Texts that none explains are tried again by themselves, as the fewer they are, the fewer of
    them prove a rare word; copies of one text are no further proof.
    """
    n_good, out, left = Counter(u for b in good for u in b), [], bad
    while left:
        n, share = Counter(u for b in left for u in b if len(u) > ORDER), len(left) / (len(left) + len(good))
        tried = {u: k for u, k in n.items() if k > 2}
        rate = PURE * len(left) / max(1, len(good))
        sure = {u: surprise(k, k + n_good[u], share) for u, k in tried.items() if k >= rate * n_good[u] and any(map(str.isalpha, u))}
        found = sorted((u for u, x in sure.items() if x > math.log(len(tried) + 1)), key=lambda u: (-sure[u], u))
        if not found:
            break
        out += found
        rest: list[set] = []
        for b in left:
            if b.isdisjoint(found) and all(2 * len(b & o) <= len(b | o) for o in rest):
                rest.append(b)
        left = rest
    return out


class Machine:
    """The fitted classifier: landmarks, one machine's weights, and the calibration of a text's score.

    Labels are those of whole texts, so each sentence has its text's label, and each unit of a
    harmless sentence is a harmless instance. A toxic sentence has some toxic unit: the
    telling ones, or any of them where none is telling. A unit that both classes use is pulled both
    ways; the kernel shares what is learned among alike units.
    """

    def __init__(self, rows: list[tuple[int, str]], landmarks: int = LANDMARKS) -> None:
        self.cache: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.prior = float(np.mean([r[0] for r in rows])) if rows else 0.0
        bags = [(y, tokens(t)) for y, t in rows]
        bad, good = [b for y, b in bags if y == 1], [b for y, b in bags if y == 0]
        self.empty = not bad or not good
        if not self.empty:
            self.fit(*([{u for t in b for u in word_units(t)} for b in bags] for bags in (bad, good)), landmarks)
            self.calibrate([[self.summary(self.token_scores(b)) for b in bags] for bags in (bad, good)])

    def ids(self, s: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings of one length, what ``table`` has of each subsequence (a row each), and the subsequences' weights."""
        i, j, k, weight = _triples(s.shape[1])
        at = np.searchsorted(self.alphabet, s.T)
        at = np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == s.T, at + 1, 0)
        n, m = len(self.alphabet) + 1, s.shape[1]
        heads = self.pairs.take(at[:, None] * n + at[None, :]).reshape(m * m, -1) * n
        return table.take(heads[i * m + j] + at[k]), weight

    @staticmethod
    def by_length(units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, codes, norms) of the units of each length that has subsequences."""
        s = _codes(units)
        lengths, out = (s != 0).sum(1), []
        for n in range(ORDER, WIDTH + 1):
            at = np.flatnonzero(lengths == n)
            for part in np.split(at, range(CHUNK, len(at), CHUNK)):
                if len(part):
                    own = s[part, :n]
                    out.append((part, own, np.sqrt(np.maximum(self_kernel(own), 1e-12))))
        return out

    def index(self, marks: list[str]) -> None:
        """Number the landmarks' subsequences; their weights in each landmark make a table, the kernel's own features."""
        self.alphabet = np.unique(np.array([ord(c) for m in marks for c in m], dtype=np.uint32))
        n, code = len(self.alphabet) + 1, {chr(c): i + 1 for i, c in enumerate(self.alphabet)}
        found = [Counter() for _ in marks]
        for m, own in zip(marks, found, strict=True):
            for a, b, c, w in zip(*_triples(len(m)), strict=True):
                own[code[m[a]], code[m[b]], code[m[c]]] += float(w)
        number = {t: i + 1 for i, t in enumerate(sorted(set().union(*found)))}
        heads = {h: i + 1 for i, h in enumerate(sorted({t[:2] for t in number}))}
        self.pairs, self.thirds = np.zeros(n * n, dtype=np.int32), np.zeros((len(heads) + 1) * n, dtype=np.int32)
        for (a, b), i in heads.items():
            self.pairs[a * n + b] = i
        for (a, b, c), i in number.items():
            self.thirds[heads[a, b] * n + c] = i
        self.parts = np.zeros((len(number) + 1, len(marks)), dtype=np.float32)
        for k, own in enumerate(found):
            norm = math.sqrt(sum(w * w for w in own.values()))
            for t, w in own.items():
                self.parts[number[t], k] = w / norm

    def features(self, units: list[str]) -> np.ndarray:
        """Nyström features of units: normalised kernels with all landmarks, whitened."""
        out = np.zeros((len(units), self.parts.shape[1]), np.float32)
        for rows, s, norm in self.by_length(units):
            which, weight = self.ids(s, self.thirds)
            for t, w in enumerate(weight):
                out[rows] += w * self.parts[which[t]]
            out[rows] /= norm[:, None]
        return out @ self.whiten

    def fit(self, bad: list[set], good: list[set], landmarks: int = LANDMARKS) -> None:
        rng = random.Random(7)
        n_bad, n_good = Counter(u for b in bad for u in b), Counter(u for b in good for u in b)
        every = sorted(u for u in n_bad.keys() | n_good.keys() if len(u) >= ORDER)
        told = telling(bad, good)
        marks = diverse(told, landmarks // 2, [], FRESH)
        marks += diverse(rng.sample(every, min(POOL, len(every))), landmarks - len(marks), marks)
        self.marks = marks
        self.index(marks)
        self.whiten = np.eye(len(marks), dtype=np.float32)
        values, vectors = np.linalg.eigh(self.features(marks).astype(float))
        self.whiten = (vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T).astype(np.float32)
        # Where telling units explain a toxic text, its other units count as what they are elsewhere only.
        known = set(told)
        n_open = Counter(u for b in bad if not b & known for u in b)
        toxic = {u: max(n_bad[u] / len(bad), LEAST) for u in known} | {u: n / len(bad) for u, n in n_open.items()}
        often = [u for u in every if n_bad[u] + n_good[u] > 2 or u in known]
        rare = sorted(set(every).difference(often))
        some = rng.sample(rare, min(RARE, len(rare)))
        weight = np.concatenate([np.ones(len(often)), np.full(len(some), len(rare) / max(1, len(some)))])
        units = often + some
        self.svm(self.features(units), weight * [toxic.get(u, 0.0) for u in units], weight * [n_good[u] / len(good) for u in units])
        del self.parts

    def svm(self, x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """A linear machine on the features, its bias last: squared hinge loss of each unit as often as it has either label, by Newton steps.

        The weights are kept as weights of subsequences, so that landmarks cost a score nothing.
        """
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        w, reg = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
        for _ in range(30):
            f = x @ w.astype(np.float32)
            on, off = toxic * (f < 1), clean * (f > -1)
            gram = np.diag(reg)
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096].astype(float)
                gram += (part * (on + off)[i : i + 4096, None]).T @ part
            new = np.linalg.solve(gram, (on - off) @ x)
            done, w = np.allclose(new, w, atol=1e-7), new
            if done:
                break
        self.alpha, self.bias = self.whiten @ w[:-1], float(w[-1])
        self.own = (self.parts @ self.alpha).astype(np.float32)[self.thirds]

    @staticmethod
    def summary(scores: np.ndarray) -> list[float]:
        """What decides on a text: its highest scores, how many units are sure or suspect, and the suspects' share."""
        top = np.sort(scores)[::-1][:TOP]
        top = np.clip(np.concatenate([top, np.full(TOP - len(top), -1.0)]), -1, 1)
        sure, suspect = int((scores > SURE).sum()), int((scores > SUSPECT).sum())
        return [*top.tolist(), math.log1p(sure), math.log1p(suspect), 12 * suspect / max(12, len(scores))]

    def calibrate(self, parts: list[list[list[float]]]) -> None:
        """Logistic regression of the texts' labels on their summaries; harmless texts weigh CLEAN times as much.

        The ridge prefers the highest score, so that one toxic unit is enough even if the toxic texts learned from have several.
        """
        x = np.array([*parts[0], *parts[1]]).reshape(-1, TOP + 3)
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.concatenate([np.ones(len(parts[0])), np.zeros(len(parts[1]))])
        c = np.where(y > 0, 1 / max(1, len(parts[0])), CLEAN / max(1, len(parts[1])))
        v, ridge = np.zeros(x.shape[1]), np.array([5e-5, *[2e-3] * (x.shape[1] - 2), 1e-6])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            grad = x.T @ (c * (p - y)) + ridge * v
            hess = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            v = v - step / max(1.0, np.linalg.norm(step) / 5)
        self.v = v

    def units_scores(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units), np.float32)
        for rows, s, norm in self.by_length(units) if units else []:
            own, weight = self.ids(s, self.own)
            out[rows] = weight @ own / norm
        return out + self.bias

    def learn_tokens(self, new: Iterable[str]) -> None:
        """Put the scores of tokens into the cache: the highest of their units."""
        new = list(new)
        units = [word_units(t) for t in new]
        flat = list(dict.fromkeys(u for us in units for u in us))
        scores = dict(zip(flat, self.units_scores(flat).tolist(), strict=True))
        self.cache.update((t, max([scores[u] for u in us], default=FLOOR)) for t, us in zip(new, units, strict=True))

    def token_scores(self, bag: set[str]) -> np.ndarray:
        if len(self.cache) > CACHE_UNITS:
            self.cache, self.older = {}, self.cache
        new = bag.difference(self.cache)
        old = self.older
        self.cache.update((t, old[t]) for t in new & old.keys())
        self.learn_tokens(t for t in new if t not in old)
        return np.array([*map(self.cache.__getitem__, bag)])

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """From 0 to 1 for every text."""
        out = []
        if self.empty:
            return [min(self.prior, 0.49)] * len(texts)
        for i in range(0, len(texts), 64):
            bags = [tokens((t or b"").decode()) for t in texts[i : i + 64]]
            self.token_scores(set().union(*bags))
            x = np.array([[*self.summary(self.token_scores(bag)), 1.0] for bag in bags])
            out += (1 / (1 + np.exp(-np.clip(x @ self.v, -30, 30)))).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learn from at most TRAIN_PER_CLASS labelled rows a class, of those that ``learn`` allows.

    Labels with a null id or label count as missing; of repeated ids' labels, the smallest is taken.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.min(label_col).alias("__label"))
    texts = docs.select(id_col, text_col, F.length(text_col).alias("__fit_chars"))  # measured here, so that only ids and lengths are shuffled to be ranked
    rows = texts.join(known.filter(F.col("__label").isin(0, 1)), F.col(id_col) == F.col("__lid")).select(id_col, text_col, "__fit_chars", "__label")
    return Machine(fit_sample(rows, "__label", learn, id_col, text_col, TRAIN_PER_CLASS))


def classify(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every whole text, each row by itself; nothing is shuffled.

    Null and empty texts have no token and get the lowest score. Null or repeated ids stay
    as they are; other columns are not read. A model without a toxic example calls nothing toxic.
    """
    model.cache, model.older = {}, {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[tuple]]:
        m = shared.value
        return lambda texts: [(s, int(s >= 0.5)) for s in m.scores(texts)]

    return map_documents(docs, make, "score double, predicted int", id_col, text_col)
