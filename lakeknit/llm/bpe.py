"""Byte-level BPE: pre-tokenisation by codepoint classes, cached pair merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_documents, worker_cache

#: Classes of codepoints; letters that a suffix after an apostrophe may have are classes of their own.
CLASSES = OTHER, LETTER, NUMBER, SPACE, BLANK, TICK, ENDING, ARE, HAVE, WILL, LAST = range(11)
#: Unicode's White_Space, and the letters of 's 't 'm 'd, 're, 've and 'll.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIX_LETTERS = {"s": ENDING, "t": ENDING, "m": ENDING, "d": ENDING, "r": ARE, "v": HAVE, "l": WILL, "e": LAST}
#: Pieces whose merges a worker remembers, twice; beyond, those that weren't seen lately are forgotten.
CACHE_PIECES = 1 << 18
#: Longer pieces are merged with a heap.
SHORT_PIECE = 48
#: States after a codepoint: nothing that counts, in letters, numbers or other marks, a blank, an apostrophe that begins
#: a match, one letter of a suffix of two (three kinds), a whole suffix.
STATES = PLAIN, LETTERS, NUMBERS, OTHERS, BLANKS, TICKED, RE, VE, LL, DONE = range(10)


def step(kind: int, state: int) -> int:
    """The state after a codepoint of a class."""
    if kind == TICK:
        # After a blank or another mark it belongs to what came before.
        return OTHERS if state in (OTHERS, BLANKS, TICKED) else TICKED
    if kind in (ENDING, ARE, HAVE, WILL) and state == TICKED:
        return {ENDING: DONE, ARE: RE, HAVE: VE, WILL: LL}[kind]
    if kind == LAST and state in (RE, VE) or kind == WILL and state == LL:
        return DONE
    return {OTHER: OTHERS, NUMBER: NUMBERS, SPACE: PLAIN, BLANK: BLANKS}.get(kind, LETTERS)


class Transitions:
    """The functions of states that codepoints and spans of them have, numbered, and how two of them compose."""

    def __init__(self) -> None:
        functions = [tuple(step(k, s) for s in STATES) for k in CLASSES]
        number: dict[tuple, int] = {}
        for f in functions:
            number.setdefault(f, len(number))
        self.of_class = np.array([number[f] for f in functions], dtype=np.uint8)
        while True:  # until every composition has a number
            known = list(number)
            for f in known:
                for g in known:
                    number.setdefault(tuple(g[x] for x in f), len(number))
            if len(number) == len(known):
                break
        self.table = np.array(known, dtype=np.uint8)
        self.constant = np.array([len(set(f)) == 1 for f in known])
        self.then = np.array([[number[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint8)

    def scan(self, functions: np.ndarray, start: int = PLAIN) -> np.ndarray:
        """The state after each codepoint, by a parallel scan over its function and those before it.

        Composition is associative, so each pass joins spans twice as long; it ends as soon as
        every span's function is constant, so that what came before it no longer counts, or reaches the start.
        """
        spans, width = functions, 1
        while width < len(spans) and not self.constant[spans[width:]].all():
            spans = np.concatenate([spans[:width], self.then[spans[:-width], spans[width:]]])
            width *= 2
        return self.table[spans, start]


TRANSITIONS = Transitions()


def class_table() -> np.ndarray:
    """The class of every codepoint."""
    kept = worker_cache("bpe_classes")
    if not kept:
        first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        table = np.array([LETTER if k == "L" else NUMBER if k == "N" else OTHER for k in first], dtype=np.uint8)
        table[WHITE] = SPACE
        table[0x20], table[0x27] = BLANK, TICK
        for letter, kind in SUFFIX_LETTERS.items():
            table[ord(letter)] = kind
        kept["table"] = table
    return kept["table"]


#: What a change of means a new piece, for each class.
_KINDS = np.array([OTHER, LETTER, NUMBER, SPACE, SPACE, OTHER, LETTER, LETTER, LETTER, LETTER, LETTER], dtype=np.uint8)


def boundaries(codepoints: np.ndarray) -> np.ndarray:
    """Where pieces start, and the end: indices of codepoints, as the public pattern splits them."""
    n = len(codepoints)
    if not n:
        return np.zeros(1, dtype=np.int64)
    full = class_table()[codepoints]
    kind = _KINDS[full]
    new = np.empty(n + 1, dtype=bool)
    new[0] = new[n] = True
    new[1:n] = kind[1:] != kind[:-1]
    # The last white space before other text: a blank joins that text, another one stands alone.
    ends = np.flatnonzero(new[1:n] & (kind[:-1] == SPACE)) + 1
    new[ends - 1] = True
    new[ends[full[ends - 1] == BLANK]] = False
    # A whole suffix is one piece with its apostrophe, whatever follows.
    state = TRANSITIONS.scan(TRANSITIONS.of_class[full])
    done = np.flatnonzero(state == DONE)
    new[np.where(state[done - 1] == TICKED, done, done - 1)] = False
    new[done + 1] = True
    return np.flatnonzero(new)


class Ranks:
    """A vocabulary of ranks: merges pieces of bytes to ids, and ids back to bytes."""

    def __init__(self, lines: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.token = {b: a for a, b in self.rank.items()}
        self.none = max(self.token, default=0) + 1
        self.text = {b: str(b) for b in self.token}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: always the pair of lowest rank first, the leftmost of equals."""
        rank = self.rank
        if piece in rank:
            return (rank[piece],)
        n = len(piece)
        if n <= SHORT_PIECE:
            return self.merged_short(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i; -1 once it is gone
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or rank.get(piece[i : end[j]]) != r:
                continue
            end[i], end[j] = end[j], -1
            k = end[i]
            if k < n:
                before[k] = i
                if (r := rank.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get(piece[h:k])) is not None:
                heapq.heappush(heap, (r, h))
        ids, i = [], 0
        while i < n:
            ids.append(rank[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def merged_short(self, piece: bytes) -> tuple[int, ...]:
        """The same by plain lists, which are faster for a few bytes."""
        none, get = self.none, self.rank.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple([self.rank[p] for p in parts])

    def pieces(self, data: bytes) -> list[bytes]:
        """The slices of a text in UTF-8 that are merged separately."""
        if data.isascii():
            at = boundaries(np.frombuffer(data, dtype=np.uint8)).tolist()
        else:
            points = np.frombuffer(data.decode().encode("utf-32-le"), dtype="<u4")
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])[boundaries(points)].tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, data: bytes) -> list[int]:
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, pieces = self.cache, self.pieces(data)
        for piece in set(pieces).difference(cache):
            cache[piece] = self.older.get(piece) or self.merged(piece)
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def offsets(self, ids: list[int]) -> list[int]:
        """Where each token's bytes begin, and the end."""
        return np.concatenate([[0], np.cumsum([len(self.token[i]) for i in ids], dtype=np.int64)]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> bytes:
    """The file of ranks, read on the driver; executors get it by broadcast (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        return f.read()


def _map(docs: DataFrame, ranks_path: str, columns: str, one: Callable[[Ranks, bytes], tuple], id_col: str, text_col: str) -> DataFrame:
    content = read_ranks(ranks_path)
    lines, digest = docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def make() -> Callable[[list], list[tuple]]:
        kept = worker_cache("bpe_ranks")
        if kept.get("lines") != digest:
            kept["lines"], kept["ranks"] = digest, Ranks(lines.value)
        ranks = kept["ranks"]
        return lambda texts: [one(ranks, t or b"") for t in texts]

    return map_documents(docs, make, columns, id_col, text_col)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): the tokens of every whole text and where their bytes begin.

    A null or empty text has no ids and the offsets [0]. Rows stay as they are, repeated
    or null ids too; other columns are not read. Nothing is shuffled.
    """

    def one(ranks: Ranks, data: bytes) -> tuple:
        ids = ranks.encode(data)
        return ids, ranks.offsets(ids)

    return _map(docs, ranks_path, "ids array<int>, offsets array<long>", one, id_col, text_col)


def decode_documents(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): ids turned back into text; bytes that aren't UTF-8 become U+FFFD. Null ids: null."""
    from pyspark.sql import functions as F

    packed = tokens.select(F.col(id_col).alias("doc_id"), F.array_join(F.col(ids_col), " ").alias("text"), F.col(ids_col).isNull().alias("__null"))

    def one(ranks: Ranks, data: bytes) -> tuple:
        return (ranks.decode([int(x) for x in data.split()]).decode(errors="replace"),)

    return _map(packed.withColumn("text", F.coalesce("text", F.lit(""))), ranks_path, "text string", one, "doc_id", "text")


def round_trips(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_equal): digests of encoding and decoding every text."""

    def one(ranks: Ranks, data: bytes) -> tuple:
        ids = ranks.encode(data)
        back = ranks.decode(ids)
        return len(ids), hashlib.sha256(" ".join(map(ranks.text.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == data

    return _map(docs, ranks_path, "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean", one, id_col, text_col)
