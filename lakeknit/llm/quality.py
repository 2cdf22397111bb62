"""Quality classifier: votes of labelled neighbours in a latent-semantic space of words, word pairs and written forms."""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FIT_PER_CLASS, by_id, fit_rows, map_documents, slices, utf8

#: Dimensions of the latent space, neighbours' weight (cosine to that power), rows of a product, and training rows a class.
DIMENSIONS = 64
SHARPNESS = 24
BLOCK = 64
TRAIN_PER_CLASS = 2 * FIT_PER_CLASS
#: Buckets of hashed terms: words, pairs of words, and runs of one to three written forms.
WORDS, PAIRS, FORMS = 1 << 13, 1 << 13, 1 << 12
TERMS = WORDS + PAIRS + FORMS
CHUNK = 1 << 12
#: Tokens whose hashes a worker remembers.
CACHE_TOKENS = 300_000
_LETTERS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUNS = re.compile(rb"([a0])\1+|(A)A+|([^aA0])\3+")
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_U = np.uint64
#: A line's end is a token of its own.
_END = b"\n"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def form_of(token: bytes) -> bytes:
    """How a token is written: letters, digits and marks, runs as one, a long run of capitals as two."""
    return _RUNS.sub(lambda m: m[1] or (m[2] and b"AA") or m[3], token.translate(_LETTERS))


class Terms(dict):
    """Numbers of tokens, and hashes of the word and the form of each, remembered for tokens seen before."""

    def __init__(self) -> None:
        self.words, self.forms = array("Q"), array("Q")

    def __missing__(self, token: bytes) -> int:
        self.words.append(xxhash.xxh64_intdigest(token.strip(_MARKS).translate(_LOWER)))
        self.forms.append(xxhash.xxh64_intdigest(form_of(token), 1))
        self[token] = len(self)
        return len(self) - 1

    def counts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of a text's terms, in order: one plus the logarithm of how often, each kind scaled to length 1.

        A form also tells whether the word is the last one again, or the one before it.
        """
        if len(self) > CACHE_TOKENS:
            self.clear()
            self.words, self.forms = array("Q"), array("Q")
        tokens = data.replace(_END, b" \x00 ").split()
        if not tokens:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        number = np.array(list(map(self.__getitem__, tokens)))
        word, form = (np.frombuffer(x, dtype=np.uint64)[number] for x in (self.words, self.forms))
        form[1:] += (word[1:] == word[:-1]).astype(np.uint64)
        form[2:] += (word[2:] == word[:-2]).astype(np.uint64) * _U(2)
        one = _mixed(form)
        two = _mixed(one[:-1] + form[1:])
        runs = np.concatenate([one, two, _mixed(two[:-1] + form[2:])])
        kinds = [(_mixed(word), WORDS, 0), (_mixed(word[:-1] * _U(3) + word[1:]), PAIRS, WORDS), (runs, FORMS, WORDS + PAIRS)]
        at, weight = [], []
        for hashes, size, first in kinds:
            n = np.bincount((hashes & _U(size - 1)).astype(np.int64), minlength=size) if len(hashes) > size // 8 else None
            bucket, n = np.unique((hashes & _U(size - 1)).astype(np.int64), return_counts=True) if n is None else ((own := np.flatnonzero(n)), n[own])
            w = 1 + np.log(n.astype(np.float32))
            at.append(bucket + first)
            weight.append(w / max(1e-9, float(np.linalg.norm(w))))
        return np.concatenate(at), np.concatenate(weight)


class Neighbours:
    """Labelled vectors in the latent space of their own terms."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.terms = Terms()
        self.empty = len({r[0] for r in rows}) < 2
        self.prior = float(np.mean([r[0] for r in rows])) if rows else 0.5
        if self.empty:
            return
        y = np.array([r[0] for r in rows], dtype=float)
        found = [self.terms.counts(t.encode()) for _, t in rows]
        seen = np.bincount(np.concatenate([at for at, _ in found]), minlength=TERMS)
        self.idf = np.where(seen > 0, np.log((1 + len(rows)) / (1 + seen)) + 1, 0).astype(np.float32)

        def columns(first: int) -> np.ndarray:
            """The rows' weights of CHUNK terms."""
            x = np.zeros((len(rows), CHUNK), dtype=np.float32)
            for own, (at, w) in zip(x, found, strict=True):
                i, j = np.searchsorted(at, (first, first + CHUNK))
                own[at[i:j] - first] = w[i:j] * self.idf[at[i:j]]
            return x

        # The singular vectors of the rows come from their products with each other.
        gram = np.zeros((len(rows), len(rows)))
        for first in range(0, TERMS, CHUNK):
            gram += (x := columns(first)) @ x.T
        values, vectors = np.linalg.eigh(gram)
        keep = np.argsort(-values)[:DIMENSIONS]
        keep = keep[values[keep] > 1e-6 * values[keep[0]]]
        onto = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.axes = np.concatenate([columns(first).T @ onto for first in range(0, TERMS, CHUNK)])
        self.vectors = self.unit((vectors[:, keep] * np.sqrt(values[keep])).astype(np.float32))
        self.axes *= self.idf[:, None]
        # A class counts as a whole, however many rows of it were learned.
        self.vote = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), -0.5 / max(1, (y <= 0).sum())).astype(np.float32)
        self.terms = Terms()

    def dump(self) -> bytes:
        """What was learned, without the class, which a task may know by another name."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k != "terms"})

    @staticmethod
    def load(data: bytes) -> Neighbours:
        out = Neighbours([])
        vars(out).update(pickle.loads(data))
        return out

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def project(self, texts: list[bytes | None]) -> np.ndarray:
        """A unit vector for each text; 0 for one without a term that was learned."""
        out = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        for own, t in zip(out, texts, strict=True):
            at, w = self.terms.counts(t or b"")
            own += w.astype(np.float32) @ self.axes[at]
        return self.unit(out)

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """From 0 to 1; every text against every labelled vector, in blocks. Equal votes, or none, give 0.5."""
        if self.empty:
            return [self.prior] * len(texts)
        out: list[float] = []
        for i in range(0, len(texts), BLOCK):
            near = np.maximum(self.project(texts[i : i + BLOCK]) @ self.vectors.T, 0) ** SHARPNESS
            good, bad = near @ np.maximum(self.vote, 0), near @ np.maximum(-self.vote, 0)
            out += ((good + 1e-9) / (good + bad + 2e-9)).astype(float).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    """Learn from at most TRAIN_PER_CLASS labelled rows a class, of those that ``learn`` allows.

    Labels with a null id or label count as missing; of repeated ids' labels, the smallest is taken.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.min(label_col).alias("__label"))
    texts = docs.select(id_col, text_col, F.length(text_col).alias("__fit_chars"))  # measured here, so that only ids and lengths are shuffled to be ranked
    rows = texts.join(known.filter(F.col("__label").isin(0, 1)), F.col(id_col) == F.col("__lid")).select(id_col, text_col, "__fit_chars", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = by_id(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([Neighbours(found).dump()], pa.binary())], names=["model"])

    # One task learns, so that neither the texts nor the work on them take memory of the driver.
    made = fit_rows(rows, "__label", learn, id_col, text_col, TRAIN_PER_CLASS).repartition(1).mapInArrow(run, "model binary").collect()
    return Neighbours.load(made[0].model) if made else Neighbours([])


def classify(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every whole text, each row by itself; nothing is shuffled.

    Null and empty texts get the score of a document without terms. Null or repeated ids
    stay as they are; other columns are not read. The broadcast model is bounded by
    TRAIN_PER_CLASS and TERMS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[tuple]]:
        m = shared.value
        return lambda texts: [(s, int(s >= 0.5)) for s in m.scores(texts)]

    return map_documents(docs, make, "score double, predicted int", id_col, text_col)


def keep_documents(docs: DataFrame, model: Neighbours, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is ``least`` or more, all columns in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([s >= least for s in m.scores(utf8(batch.column(column)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
