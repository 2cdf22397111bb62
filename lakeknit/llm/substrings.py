"""Substring dedup: recompression names equal passages alike; shared symbols reveal repeats, which are verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, discard, slices, spark_schema_to_arrow, staged, utf8

WINDOW = 35
#: Rounds of naming; a symbol stands for its windows if at most CONTEXT words decide on it. Those words name the anchor, too.
ROUNDS = 4
CONTEXT = 12
#: Words that are named at a time.
CHUNK_WORDS = 400_000
_FAR = 1 << 40
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Symbols:
    """A level of the parse: names, where symbols begin and end, and which words decide on them; none spans documents."""

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> None:
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is a symbol to the left and right in the document, and the words that decide on it."""
        same = self.doc[1:] == self.doc[:-1]
        left, right = np.concatenate([[False], same]), np.concatenate([same, [False]])
        low = np.where(left, np.concatenate([self.low[:1], self.low[:-1]]), -_FAR)
        high = np.where(right, np.concatenate([self.high[1:], self.high[-1:]]), _FAR)
        return left, right, low, high

    def runs(self) -> Symbols:
        """Name each maximal run of equal symbols by the symbol and its length; both neighbours decide on it."""
        n = len(self.name)
        if not n:
            return self
        first = np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])])
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [n]]) - 1
        _, _, low, high = self._neighbours()
        length = (last - at + 1).astype(np.uint64)
        name = np.where(length > 1, mixed(self.name[at] * _U(0xD6E8FEB86659FD93) + length), self.name[at])
        return Symbols(name, self.start[at], self.end[last], np.minimum(self.low[at], low[at]), np.maximum(self.high[last], high[last]), self.doc[at])

    def pairs(self, salt: int) -> Symbols:
        """Name pairs of a symbol of the left half of the alphabet and one of the right half, as hashed bits divide it."""
        n = len(self.name)
        if not n:
            return self
        right_half = (mixed(self.name + _U(salt * 0x632BE59BD9B4E019 % (1 << 64))) >> _U(63)).astype(bool)
        _, _, low, high = self._neighbours()
        joins = np.zeros(n, dtype=bool)  # with the next symbol
        joins[:-1] = ~right_half[:-1] & right_half[1:] & (self.doc[1:] == self.doc[:-1])
        gone = np.concatenate([[False], joins[:-1]])
        at = np.flatnonzero(~gone)
        pair = joins[at]
        nxt = np.minimum(at + 1, n - 1)
        name = np.where(pair, mixed(mixed(self.name[at]) + self.name[nxt] * _U(0xA0761D6478BD642F)), self.name[at])
        # Alone, a left symbol needs the one after it, and a right symbol the one before.
        lone_low = np.where(right_half[at], np.minimum(self.low[at], low[at]), self.low[at])
        lone_high = np.where(right_half[at], self.high[at], np.maximum(self.high[at], high[at]))
        return Symbols(
            name,
            self.start[at],
            np.where(pair, self.end[nxt], self.end[at]),
            np.where(pair, np.minimum(self.low[at], self.low[nxt]), lone_low),
            np.where(pair, np.maximum(self.high[at], self.high[nxt]), lone_high),
            self.doc[at],
        )


def choose_anchors(hashes: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's name, hash of their words) of runs of windows that have the same anchor.

    ``hashes`` are the words of several documents in a row, ``doc`` their documents. A
    window's anchor is the longest symbol on which only words inside the window decide
    (with a hash among equals, the leftmost at last), so equal windows have equally named
    anchors at the same place, wherever they stand.
    """
    n, context = len(hashes), min(context, window)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    places = np.arange(n)
    level = Symbols(hashes, places, places + 1, places, places + 1, doc)
    value, name = (_U(1) << _U(58)) | (mixed(hashes) >> _U(6)), hashes.copy()
    for r in range(rounds):
        for step in ("runs", "pairs") if r == 0 else ("pairs",):
            level = level.runs() if step == "runs" else level.pairs(r + 1)
            fit = np.flatnonzero(level.high - level.low <= context)
            at, length = level.low[fit], np.minimum(level.end[fit] - level.start[fit], 60).astype(np.uint64)
            new = (length << _U(58)) | (mixed(level.name[fit]) >> _U(6))
            if len(at):
                # Of symbols that share their first deciding word, which are neighbours, the best counts.
                group = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                top = np.repeat(np.maximum.reduceat(new, group), np.diff(np.concatenate([group, [len(at)]])))
                better = (new == top) & (new > value[at])
                value[at[better]], name[at[better]] = new[better], level.name[fit][better]
    # The leftmost best place among the first window - context + 1 of each window.
    width, best, have = window - context + 1, places.copy(), 1
    while have < width:
        step = min(have, width - have)
        other = best[np.minimum(places + step, n - 1)]
        best = np.where(value[best] >= value[other], best, other)
        have += step
    valid = np.zeros(n, dtype=bool)
    valid[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
    w = np.flatnonzero(valid)
    if not len(w):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = best[w]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1) | (doc[w[1:]] != doc[w[:-1]])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(w)]]))
    begin, anchor = w[first], anchor[first]
    of = span_hashes(hashes)
    whole = mixed(of(begin, begin + count + window - 1) + mixed((anchor - begin).astype(np.uint64) * _U(64) + count.astype(np.uint64)))
    return begin, count, mixed(name[anchor] + of(anchor, anchor + context)), whole


def span_hashes(hashes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from places (begin, end) to a hash of the words there, by prefix sums of a polynomial modulo 2**64."""
    n = len(hashes)
    powers = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))])
    inverse = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(n, _BASE_INVERSE, dtype=np.uint64))])
    sums = np.concatenate([[_U(0)], np.add.accumulate(mixed(hashes) * powers[:-1])])
    return lambda a, b: mixed((sums[b] - sums[a]) * inverse[a])


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _chunks(texts: list[bytes | None], window: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of long enough texts with the hashes of their words, each word's row, and where each row's words begin."""
    rows: list[int] = []
    words: list[bytes] = []
    sizes: list[int] = []
    for i, t in enumerate(texts):
        own = (t or b"").split()
        if len(own) >= window:
            rows.append(i)
            words += own
            sizes.append(len(own))
        if len(words) >= CHUNK_WORDS or (i == len(texts) - 1 and words):
            starts = np.concatenate([[0], np.cumsum(sizes)])
            yield rows, word_hashes(words), np.repeat(np.arange(len(rows)), sizes), starts
            rows, words, sizes = [], [], []


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, spans): per document, where words of repeated windows stand: (place, mask of the windows from there).

    ``docs`` has doc_id, text and th, the text's hash, which tells rows of equal ids apart.
    Rows of equal anchor name and equal words around it are verified repeats at once. Where
    a name has several surroundings, one row of each sends the hash of every window, so
    that copies cost one comparison, however many they are. All groups are sums or equi-joins
    with one row a key.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"name long, whole long, doc_id {kind}, th long, pos int, k int"
    fields = spark_schema_to_arrow(docs.sparkSession, schema)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 * SLICE_ROWS):
            for rows, hashes, doc, starts in _chunks(utf8(batch.column(1)), window):
                begin, count, name, whole = choose_anchors(hashes, doc, window)
                own = doc[begin] if len(begin) else begin
                at = pa.array(np.array(rows, dtype=np.int64)[own])
                columns = [_signed(name), _signed(whole), batch.column(0).take(at).cast(fields[2].type), batch.column(2).take(at), pa.array((begin - starts[own]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    found = staged(docs.select("doc_id", "text", "th").mapInArrow(anchors, schema), "anchors")
    names = found.groupBy("name").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).filter("n > 1").select("name", F.expr("a <> b").alias("mixed"))
    names = staged(names, "names")  # read again, both sides of the join are plain shuffles, whose hot keys can be split
    places = found.join(names, "name").select("mixed", F.expr("if(mixed, name, null)").alias("name"), F.expr("if(mixed, whole, null)").alias("whole"), "doc_id", "th", "pos", "k")
    places = staged(places, "places")
    discard(found)
    discard(names)
    several = places.filter("mixed")

    # One row of each variant of a name that has several.
    variants = staged(several.groupBy("name", "whole").agg(F.count("*").alias("n"), F.min(F.struct("th", "pos", "k", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("x")).select("name", "whole", "n", "x.*"), "variants")
    wanted = variants.groupBy("doc_id", "th").agg(F.collect_list(F.struct("name", "whole", "pos", "k")).alias("asked"))
    text = docs.alias("d").join(wanted.alias("q"), F.expr("d.th = q.th AND d.doc_id <=> q.doc_id")).select("d.text", "q.asked")
    out = "name long, whole long, i int, hash long, back int"
    out_fields = spark_schema_to_arrow(docs.sparkSession, out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(1)
            for t, asked in zip(utf8(batch.column(0)), lists, strict=True):
                hashes = word_hashes(t.split())
                of = span_hashes(hashes)
                x = asked.values
                pos, k = x.field("pos").to_numpy(), x.field("k").to_numpy()
                row = np.repeat(np.arange(len(pos)), k)
                i = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                w = pos[row] + i
                take = pa.array(row)
                # The second hash, of the half of the window, makes the first one's collisions harmless.
                half = of(w, w + window // 2) & _U(0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([x.field("name").take(take), x.field("whole").take(take), pa.array(i.astype(np.int32)), _signed(of(w, w + window)), pa.array(half.astype(np.int32))], schema=pa.schema(out_fields))

    each = staged(text.mapInArrow(windows, out), "windows")
    twice = each.groupBy("name", "hash", "back").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).filter("a <> b").select("name", "hash", "back")
    masks = each.join(twice, ["name", "hash", "back"], "left_semi").groupBy("name", "whole").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    # All windows of a variant that stands in several places, or those that other variants have.
    marked = staged(variants.select("name", "whole", "n").join(masks, ["name", "whole"], "left").filter("n > 1 OR mask IS NOT NULL").select("name", "whole", F.expr("if(n > 1, -1L, mask)").alias("mask")), "masks")
    discard(each)
    discard(variants)
    every = F.expr("shiftleft(1L, k) - 1")
    full = places.filter("NOT mixed").select("doc_id", "th", "pos", every.alias("mask"))
    part = several.join(marked, ["name", "whole"]).select("doc_id", "th", "pos", F.col("mask").bitwiseAND(every).alias("mask"))
    return full.union(part).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "mask")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document row: its words but for those of repeated windows.

    A word is a run of bytes that aren't ASCII white space. A window is ``window`` words of
    one document; all windows whose words also stand elsewhere, in the same document too,
    lose all their words, as judged on the input. Null texts have no words; texts of fewer
    words lose none; repeated rows and null ids stay, and rows that repeat repeat each
    other's windows. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    if not 2 <= window <= 62 + CONTEXT:
        raise ValueError(f"a window has from 2 to {62 + CONTEXT} words")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(slim, window)
    joined = slim.alias("d").join(spans.alias("q"), F.expr("d.th = q.th AND d.doc_id <=> q.doc_id"), "left").select("d.doc_id", "d.text", F.col("q.spans.pos").alias("pos"), F.col("q.spans.mask").alias("mask"))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    fields = spark_schema_to_arrow(docs.sparkSession, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, removed, kept = [], [], []
            for t, pos, mask in zip(utf8(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = t.split()
                total.append(len(words))
                if pos.is_valid:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for p, m in zip(pos.as_py(), mask.as_py(), strict=True):
                        bits = np.flatnonzero([(m >> i) & 1 for i in range(m.bit_length())]) + p
                        np.add.at(change, bits, 1)
                        np.add.at(change, bits + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(fields[0].type), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, fields[3].type)], schema=pa.schema(fields))

    return joined.mapInArrow(cut, schema)
