"""Similarities of two records' fields, as SQL expressions; Jaro-Winkler in Spark is an Arrow function."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .dialect import Spark


def jaccard(d: Spark, x: str, y: str) -> str:
    """Common share of two sets; two empty ones are equal."""
    return f"CASE WHEN {d.size(x)} = 0 AND {d.size(y)} = 0 THEN CAST(1 AS DOUBLE) ELSE CAST({d.size(d.common(x, y))} AS DOUBLE) / {d.size(d.either(x, y))} END"


def dice(d: Spark, x: str, y: str) -> str:
    """Twice the common elements by the sets' sizes; 0 if either is empty."""
    return f"CASE WHEN {d.size(x)} = 0 OR {d.size(y)} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * {d.size(d.common(x, y))} / ({d.size(x)} + {d.size(y)}) END"


def levenshtein_ratio(d: Spark, a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN CAST(1 AS DOUBLE) WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST({d.levenshtein(a, b)} AS DOUBLE) / greatest(length({a}), length({b})) END"


def prefix_ratio(d: Spark, a: str, b: str) -> str:
    """The common beginning by the shorter text's length; 0 if either is empty."""
    same = d.size(d.keep(d.numbers("1", f"greatest(1, least(length({a}), length({b})))"), "i", f"left({a}, CAST(i AS INT)) = left({b}, CAST(i AS INT))"))
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE CAST({same} AS DOUBLE) / least(length({a}), length({b})) END"


def transposed(d: Spark, x: str, y: str) -> str:
    """Whether two different numbers of equal length have the same digits."""
    order = lambda v: d.join(d.sorted(d.each(d.numbers("1", f"length({v})"), "i", f"substring({v}, CAST(i AS INT), 1)")), "")
    inner = d.any(y, "q", f"p <> q AND length(p) = length(q) AND {order('p')} = {order('q')}")
    return f"CASE WHEN {d.any(x, 'p', inner)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def jaro_winkler_one(a: str, b: str) -> float:
    """Jaro's similarity of the UTF-8 bytes, as the SQL counts them, raised by a tenth of the rest for each of up to four common first characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    a, b = a.encode(), b.encode()
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), -1)
        if j >= 0:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, open_ in zip(b, free, strict=True) if not open_]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    return jaro + start / 10 * (1 - jaro)


#: Texts of more bytes are compared one by one, not in a table of that width.
WIDE = 96


def jaro_winkler_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``jaro_winkler_one`` of each pair, by whole columns of bytes: step i gives the i-th byte of every first text its first free partner."""
    out = np.empty(len(pairs))
    short = []
    for k, (a, b) in enumerate(pairs):
        if a == b or not a or not b or len(a) > WIDE or len(b) > WIDE or max(len(a.encode()), len(b.encode())) > WIDE:
            out[k] = jaro_winkler_one(a, b)
        else:
            short.append(k)
    if not short:
        return out
    start = np.array([next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b))) for a, b in (pairs[k] for k in short)])
    texts = [[pairs[k][side].encode() for k in short] for side in (0, 1)]
    la, lb = (np.array([len(t) for t in side]) for side in texts)
    a, b = (np.frombuffer(b"".join(t.ljust(n.max(), b"\0") for t in side), dtype=np.uint8).reshape(len(short), n.max()) for side, n in zip(texts, (la, lb), strict=True))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    rows, columns = np.arange(len(short)), np.arange(b.shape[1], dtype=np.int16)
    free, used = columns < lb[:, None], np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        lo, hi = max(0, i - int(reach.max())), min(b.shape[1], i + int(reach.max()) + 1)
        fits = (b[:, lo:hi] == a[:, i, None]) & free[:, lo:hi] & (np.abs(columns[lo:hi] - i) <= reach[:, None]) & (i < la)[:, None]
        if fits.shape[1]:
            hit, j = fits.any(axis=1), fits.argmax(axis=1) + lo
            used[hit, i] = True
            free[rows[hit], j[hit]] = False
    taken = ~free & (columns < lb[:, None])
    m = used.sum(axis=1)
    left, right = (np.take_along_axis(t, np.argsort(~own, axis=1, kind="stable"), axis=1)[:, : m.max()] for t, own in ((a, used), (b, taken)))
    moved = ((left != right) & (np.arange(left.shape[1]) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = (m / la + m / lb + (m - moved) / some) / 3
    out[short] = np.where(m == 0, 0.0, jaro + start / 10 * (1 - jaro))
    return out


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler`` and ``strip_marks`` known to the session's SQL: texts travel in Arrow batches, equal pairs are compared once a batch."""

    @F.pandas_udf("double")
    def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        known = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
        return pd.Series(jaro_winkler_many(list(known))[[known[pair] for pair in pairs]], dtype="float64")

    @F.pandas_udf("string")
    def strip_marks(s: pd.Series, form: pd.Series) -> pd.Series:
        """Decomposed and without marks that don't take space; null stays null."""
        one = lambda t, f: None if t is None else "".join(c for c in unicodedata.normalize(f, t) if unicodedata.category(c) != "Mn")
        return pd.Series([one(t, f) for t, f in zip(s, form, strict=True)], dtype=object)

    spark.udf.register("jaro_winkler", jaro_winkler)
    spark.udf.register("strip_marks", strip_marks)


def jaro_winkler(d: Spark, a: str, b: str) -> str:
    if d.name == "spark":
        return f"jaro_winkler({a}, {b})"
    same = f"len(list_filter(range(1, 5), lambda i: i <= least(length({a}), length({b})) AND left({a}, CAST(i AS INT)) = left({b}, CAST(i AS INT))))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN jaro_similarity({a}, {b}) = 0 THEN 0.0 ELSE jaro_similarity({a}, {b}) + 0.1 * {same} * (1 - jaro_similarity({a}, {b})) END"
