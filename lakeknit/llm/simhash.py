"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, map_documents, staged

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Tries, each with another part of the bits first.
TRIES = 3


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, as a signed number: the majority of each bit over the XXH64 of all shingles; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text; null and empty texts have 0."""

    def make() -> Callable[[list], list[tuple]]:
        return lambda texts: [(fingerprint(t or b"", shingle),) for t in texts]

    return map_documents(docs, make, "fp long", id_col, text_col)


def _rotated(v: Column, by: int) -> Column:
    return F.shiftleft(v, by).bitwiseOR(F.shiftrightunsigned(v, 64 - by)) if by else v


def trie_links(fps: DataFrame, budget: int = BUDGET, tries: int = TRIES) -> DataFrame:
    """(a, b), a <> b: all pairs of the different values in ``fps.fp`` with at most ``budget`` differing bits.

    The bits are cut into as many blocks as there are tries; in a pair, one block has at
    most budget // tries differing bits. Each trie has its block first. Pairs of nodes are
    traversed together, a few levels at a time down to the leaves: the differing bits add up, and
    a pair ends where they exceed the block's share or, below the block, the whole budget.
    Each step is an equi-join of node pairs with their nodes' children. Different fingerprints
    that are all within the budget of each other are listed pair by pair.
    """
    block, share = 64 // tries, budget // tries
    leaves = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("rot"), _rotated(F.col("fp"), r * block).alias("v")) for r in range(tries)])).alias("x")).select("x.rot", "x.v")
    depths = [d for d in (10, 16, *range(21, block, 5), block, *range(block + 12, 60, 12)) if d < 64]

    def prefix(depth: int) -> Column:
        return F.shiftrightunsigned("v", 64 - depth) if depth < 64 else F.col("v")

    root = leaves.select("rot", prefix(depths[0]).alias("a")).distinct()
    flips = [sum(1 << i for i in c) for n in range(share + 1) for c in combinations(range(depths[0]), n)]
    pairs = root.select("rot", "a", F.explode(F.array(*[F.lit(m) for m in flips])).alias("m")).select("rot", "a", F.col("a").bitwiseXOR(F.col("m").cast("long")).alias("b")).filter("a <= b")
    pairs = pairs.join(root.select("rot", F.col("a").alias("b")), ["rot", "b"], "left_semi")
    for depth, below in zip(depths, [*depths[1:], 64], strict=True):
        nodes = leaves.select("rot", prefix(depth).alias("up"), prefix(below).alias("c")).distinct()
        low, high = (nodes.select("rot", F.col("up").alias(up), F.col("c").alias(child)) for up, child in (("a", "va"), ("b", "vb")))
        near = F.expr(f"bit_count(va ^ vb) <= {share if below <= block else budget} AND (p.a <> p.b OR va {'<' if below == 64 else '<='} vb)")
        found = pairs.join(low, ["rot", "a"]).alias("p").join(high.alias("h"), (F.col("p.rot") == F.col("h.rot")) & (F.col("p.b") == F.col("h.b")) & near)
        pairs = found.select("p.rot", F.col("va").alias("a"), F.col("vb").alias("b"))

    def back(c: str) -> Column:
        out = F.col(c)
        for r in range(1, tries):
            out = F.when(F.col("rot") == r, _rotated(F.col(c), 64 - r * block)).otherwise(out)
        return out

    return pairs.select(back("a").alias("a"), back("b").alias("b")).distinct()


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``prints`` (doc_id, fp).

    component_id is the smallest id that links reach, itself included; null ids count only
    where a component has no other. Rows with equal fingerprints are one class, and only
    classes are joined, so copies cost one row however many they are.
    """
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = connected_components(trie_links(classes, budget))
    named = staged(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "named")
    discard(roots)
    discard(classes)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(named.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document, repeated rows and null ids included.

    Empty tables give no rows; other columns are not read.
    """
    return components(staged(fingerprints(docs, shingle, id_col, text_col), "prints"), budget)
