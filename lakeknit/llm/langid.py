"""Language identification by expectation-maximisation over a mixture of languages."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame

from .common import fit_sample, map_documents

#: Buckets of hashed character trigrams, the weight of unseen ones, the change of a proportion from which EM goes on, and the penalty of a further language.
BUCKETS = 1 << 14
SMOOTH = 0.05
SETTLED = 1e-4
PENALTY = 3.0
UNDETERMINED = "und"

#: Letters in lower case; every other ASCII byte counts as a blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def trigram_buckets(data: bytes) -> np.ndarray:
    """The bucket of every byte trigram with at least one letter's byte."""
    b = _FOLD[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    x = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    x = x[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return ((x * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


class Mixture:
    """Trigram probabilities of each language, learned from (language, text) rows."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((BUCKETS, len(self.langs)))
        for lang, text in rows:
            counts[:, self.langs.index(lang)] += np.bincount(trigram_buckets(text.encode()), minlength=BUCKETS)
        if self.langs:
            self.p = (counts + SMOOTH) / (counts + SMOOTH).sum(0)

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """EM for one document: the languages' proportions and the log-likelihood; p: of its trigrams, n: their counts."""
        pi = np.full(p.shape[1], 1 / p.shape[1])
        if p.shape[1] > 1:
            total = n.sum()
            while True:  # the likelihood grows each round, so the proportions settle
                last, pi = pi, pi * ((n / (p @ pi)) @ p) / total
                if np.abs(pi - last).max() < SETTLED:
                    break
        return pi, float(n @ np.log(p @ pi))

    def predict(self, data: bytes) -> tuple[str, float]:
        """(language, score): the largest proportion in the set of languages with the best penalised likelihood.

        Ties go to the language that sorts first. A text without letters, or a model
        without languages, gives ("und", 0.0).
        """
        if not self.langs or not has_letter(data):
            return UNDETERMINED, 0.0
        at, n = np.unique(trigram_buckets(data), return_counts=True)
        if not len(at):
            return self.langs[0], 1 / len(self.langs)
        p, n = self.p[at], n.astype(float)
        single = n @ np.log(p)
        chosen = [int(np.argmax(single))]
        pi, best = np.ones(1), float(single[chosen[0]])
        full, _ = self.proportions(p, n)
        cost = PENALTY * np.log(n.sum() + 1)
        for k in np.argsort(-full, kind="stable"):
            if k in chosen:
                continue
            more, fit = self.proportions(p[:, [*chosen, int(k)]], n)
            if fit - cost <= best:
                break
            chosen, pi, best = [*chosen, int(k)], more, fit - cost
        top = min(range(len(chosen)), key=lambda i: (-pi[i], chosen[i]))
        return self.langs[chosen[top]], float(min(1.0, pi[top]))


def has_letter(data: bytes) -> bool:
    """Whether a text has a Unicode letter."""
    return bool(re.search(rb"[A-Za-z]", data)) or (not data.isascii() and any(map(str.isalpha, data.decode())))


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Learn from at most common.FIT_PER_CLASS rows a language, of those that ``learn`` allows."""
    return Mixture(fit_sample(docs, lang_col, learn, id_col, text_col))


def identify(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text, each row by itself; nothing is shuffled.

    Null texts and texts without letters: ``und`` and 0. Null or repeated ids stay as they are;
    other columns are not read. The model's size is fixed by BUCKETS and its languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[tuple]]:
        m = shared.value
        return lambda texts: [m.predict(t or b"") for t in texts]

    return map_documents(docs, make, "lang_pred string, score double", id_col, text_col)
