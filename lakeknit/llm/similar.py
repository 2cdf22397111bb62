"""Near-duplicates of a given similarity: long SimHashes, binary tries joined block by block, sets of shingles compared.

The four-bit links of ``simhash`` find copies that differ in a few words. Documents whose
five-word shingles have a Jaccard similarity of 0.8 differ in 15 % of their bits; to find them,
768 bits are covered by 40 blocks of 26 that overlap, each a trie whose node pairs are traversed
together within an error budget of one bit. What passes is held against the whole budget, then
against the sets. A lone pair of long texts is found so with a probability of 0.95 at a similarity
of 0.8, and 0.99 at 0.85.

Two kinds of documents are compared by their sets alone, with no loss: those of few shingles,
whose bits say little, and those near a crowded node, whose pairs would be too many. Their sets meet
in a join on the rarest shingles; the texts of a group first meet its most central one only.
Shingles are 32-bit hashes and texts are told apart by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, map_documents, staged

SHINGLE = 5
SIMILARITY = 0.8
PRINTS = 12
#: Blocks of the fingerprint's bits, how long they are and how far apart, and how many bits of one block may differ.
BLOCKS, BITS, STRIDE, SHARE = 40, 26, 19, 1
#: Bits of all that may differ: 2.5 standard deviations over those of the similarity itself.
BUDGET = 141
#: A node with more leaves is crowded; sets of at most FEW shingles are always compared exactly.
CROWD = 16
FEW = 48
#: Shingles are put in order by the counts of so many buckets, a byte each, which every task gets.
BUCKETS = 1 << 21
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(1, PRINTS + 1)], dtype=np.uint64)


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles of lower-cased words; a shorter text is one shingle, one without words has none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def long_print(hashes: np.ndarray) -> np.ndarray:
    """``PRINTS`` words of 64 bits: each bit is the majority over the hashes, mixed anew for each word."""
    ones = np.zeros(64 * PRINTS, dtype=np.int64)
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] ^ _MIX[None, :]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, parts) of every whole text: a hash of its words in lower case, its fingerprint (none for few shingles), its shingles."""

    def make() -> Callable[[list], list[tuple]]:
        def one(text: bytes | None) -> tuple:
            data = text or b""
            found = shingles(data, size)
            key = xxhash.xxh64_intdigest(b" ".join(data.lower().split()), 7)
            parts = np.unique(found.astype(np.uint32)).view(np.int32).tolist()
            return key - (key >> 63 << 64), long_print(found).tolist() if len(parts) > FEW else None, parts

        return lambda texts: [one(t) for t in texts]

    return map_documents(docs, make, "key long, fp array<long>, parts array<int>", id_col, text_col)


def block(i: int) -> Column:
    """The bits of block ``i`` of a fingerprint."""
    word, off = divmod(i * STRIDE, 64)
    low = F.call_function("shiftrightunsigned", F.col("fp")[word], F.lit(off))
    whole = low if off + BITS <= 64 else low.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], 64 - off))
    return whole.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")


def leaves_of(classes: DataFrame) -> DataFrame:
    """(key, rot, v): a leaf of each trie for every fingerprint."""
    return classes.filter("fp IS NOT NULL").select("key", F.posexplode(F.array(*map(block, range(BLOCKS)))).alias("rot", "v"))


def node_pairs(leaves: DataFrame) -> DataFrame:
    """(rot, a, b, na, nb), a <= b: the ends of each trie with at most ``SHARE`` differing bits and how many leaves they have.

    Pairs of nodes are traversed together, and pruned where the budget is exceeded; an end
    pairs with itself where several leaves share it.
    """
    depths = [10, 16, BITS]

    def prefix(depth: int) -> Column:
        return F.shiftright("v", BITS - depth)

    root = leaves.select("rot", prefix(depths[0]).alias("a")).distinct()
    masks = F.array(*[F.lit(m) for m in chain([0], (1 << i for i in range(depths[0])))])
    pairs = root.select("rot", "a", F.explode(masks).alias("m")).select("rot", "a", F.col("a").bitwiseXOR(F.col("m")).alias("b")).filter("a <= b")
    pairs = pairs.join(root.select("rot", F.col("a").alias("b")), ["rot", "b"], "left_semi")
    for depth, below in zip(depths, depths[1:], strict=False):
        nodes = leaves.groupBy("rot", prefix(depth).alias("up"), prefix(below).alias("v")).agg(F.count("*").cast("int").alias("n"))
        own = "na > 1" if below == BITS else "TRUE"
        low = nodes.select("rot", F.col("up").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"))
        high = nodes.select("rot", F.col("up").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
        near = F.expr(f"(va < vb OR va = vb AND {own}) AND bit_count(va ^ vb) <= {SHARE}")
        found = pairs.join(low, ["rot", "a"]).alias("p").join(high.alias("h"), (F.col("p.rot") == F.col("h.rot")) & (F.col("p.b") == F.col("h.b")) & near)
        pairs = found.select("p.rot", F.col("va").alias("a"), F.col("vb").alias("b"), *(["na", "nb"] if below == BITS else []))
    return pairs


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the pairs whose whole fingerprints are within the budget."""
    one = pairs.join(classes.select(F.col("key").alias("a"), F.col("fp").alias("fa")), "a")
    two = one.join(classes.select(F.col("key").alias("b"), F.col("fp").alias("fb")), "b")
    diff = reduce(lambda x, y: x + y, [F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(PRINTS)])
    return two.filter(diff <= BUDGET).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sets of shingles have that similarity or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("parts").alias("pa")), "a").join(sets.select(F.col("key").alias("b"), F.col("parts").alias("pb")), "b")
    meet = F.size(F.array_intersect("pa", "pb"))
    return both.filter(meet >= similarity * (F.size("pa") + F.size("pb") - meet) - 1e-9).select("a", "b")


def loose_pairs(near: DataFrame, leaves: DataFrame) -> DataFrame:
    """(a, b): leaves of paired nodes that aren't crowded, so at most CROWD of each, but for those that ``exact`` compares anyway."""
    low = leaves.select("rot", F.col("v").alias("a"), F.col("key").alias("ka"), F.col("exact").alias("ea"))
    high = leaves.select(F.col("rot").alias("r2"), F.col("v").alias("b2"), F.col("key").alias("kb"), F.col("exact").alias("eb"))
    some = near.filter(f"na <= {CROWD} AND nb <= {CROWD}").join(low, ["rot", "a"])
    wide = some.join(high, F.expr("rot = r2 AND b = b2 AND (a < b OR ka < kb) AND NOT (ea AND eb)"))
    return wide.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def rarity(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each bucket occur in ``sets``, as eighths of the binary logarithm: 0 where at most one does."""
    counts = sets.select(F.explode("parts").alias("token")).groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS, dtype=np.uint8)
        for batch in batches:
            out[batch.column(0).to_numpy()] = np.round(8 * np.log2(batch.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["seen"])

    made = counts.repartition(1).mapInArrow(run, "seen binary").collect()
    return np.frombuffer(made[0].seen, dtype=np.uint8) if made else np.zeros(BUCKETS, dtype=np.uint8)


def rare_parts(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, n, token, pos): the rarest shingles of each set, of which similar sets share one.

    Two sets of that similarity have common shingles among the first n - similarity * n + 1
    of each in any one order; here, by how often their bucket occurs in ``sets``, so that no set
    looks up each of its shingles. Those alone in their bucket come first and are left out, as they meet nothing.
    """
    shared = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            keys, parts = batch.column(0).to_numpy(), batch.column(1)
            n, token = parts.value_lengths().to_numpy(), parts.flatten().to_numpy()
            row, often = np.repeat(np.arange(len(n)), n), seen[token & (BUCKETS - 1)]
            order = np.lexsort((token, often, row))
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(n * similarity - 1e-9) + 1
            kept = (pos < most[row]) & (often[order] > 0)
            first = row[kept]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(n[first]), pa.array(token[order][kept]), pa.array(pos[kept].astype(np.int32))], names=["key", "n", "token", "pos"])

    return sets.select("key", "parts").mapInArrow(run, "key long, n int, token int, pos int")


def _fits(similarity: float) -> Column:
    """Whether a common shingle at these places leaves room for enough common ones."""
    need = (F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-9
    return F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= need


def exact_links(sets: DataFrame, similarity: float) -> list[DataFrame]:
    """Tables of links (a, b) that join all pairs of ``sets`` (key, parts) of that similarity, though not each pair of a group.

    First each set meets, for each of its rare shingles, the one set whose other shingles are the least
    rare. Then those outside a shingle's largest component meet the others that have it, so a
    group never lists its pairs, however large it is.
    """
    prefix = staged(rare_parts(sets, similarity), "prefix")
    best = prefix.groupBy("token").agg(F.min(F.struct("pos", "key", "n")).alias("x"), F.count("*").alias("c")).filter("c > 1")
    centre = best.select("token", F.col("x.key").alias("key2"), F.col("x.n").alias("n2"), F.col("x.pos").alias("pos2"))
    star = prefix.join(centre, "token").filter((F.col("key") != F.col("key2")) & _fits(similarity))
    stars = staged(verified(_ordered(star), sets, similarity), "links")
    comps = connected_components(stars)
    tagged = staged(prefix.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component"), "tagged")
    discard(comps)
    discard(prefix)
    each = tagged.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = each.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("x.comp").alias("main"))
    kept = staged(tagged.join(main, "token"), "apart")
    discard(tagged)
    other = kept.select("token", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"), (F.col("comp") == F.col("main")).alias("ismain"))
    apart = kept.filter("comp <> main").alias("x").join(other.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("comp") != F.col("comp2")) & (F.col("ismain") | (F.col("key") < F.col("key2"))) & _fits(similarity))
    rest = staged(verified(_ordered(apart), sets, similarity), "links")
    discard(kept)
    return [stars, rest]


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def links(prints: DataFrame, similarity: float = SIMILARITY) -> list[DataFrame]:
    """Tables of links (a, b) between keys that join all similar texts found; ``prints`` is staged and discarded."""
    # Columns of one word each have cheap minima; all rows of a key have the same.
    lows = prints.groupBy("key").agg(F.min(F.size("parts")).alias("n"), *[F.min(F.get("fp", F.lit(i))).alias(f"f{i}") for i in range(PRINTS)])
    classes = staged(lows.select("key", "n", F.when(F.col("f0").isNotNull(), F.array(*[f"f{i}" for i in range(PRINTS)])).alias("fp")), "classes")
    leaves = leaves_of(classes)
    near = staged(node_pairs(leaves), "near")
    full = near.filter(f"na > {CROWD} OR nb > {CROWD}")
    zone = full.select("rot", F.col("a").alias("v")).union(full.select("rot", F.col("b").alias("v"))).distinct()
    small = classes.filter((F.col("n") > 0) & (F.col("n") <= FEW / similarity)).select("key")
    exact = staged(leaves.join(zone, ["rot", "v"], "left_semi").select("key").union(small).distinct(), "exact")
    known = exact.select("key", F.lit(True).alias("known"))
    tagged = staged(leaves.join(known, "key", "left").select("key", "rot", "v", F.coalesce("known", F.lit(False)).alias("exact")), "tagged")
    pairs = staged(loose_pairs(near, tagged), "pairs")
    discard(near)
    discard(tagged)
    close = staged(close_pairs(pairs, classes), "close")
    discard(pairs)
    discard(classes)
    wanted = close.select(F.col("a").alias("key")).union(close.select(F.col("b").alias("key"))).union(exact).distinct()
    sets = staged(prints.select("key", "parts").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "sets")
    discard(prints)
    found = [staged(verified(close, sets, similarity), "links")]
    discard(close)
    few = staged(sets.join(exact, "key", "left_semi"), "sets")
    discard(sets)
    discard(exact)
    found += exact_links(few, similarity)
    discard(few)
    return found


def components(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, component_id) of each row of staged ``prints``: the smallest id that links reach; null ids count only where there is no other."""
    names = staged(prints.select("doc_id", "key"), "names")
    found = links(prints, similarity)
    roots = connected_components(reduce(DataFrame.union, found))
    for x in found:
        discard(x)
    lows = names.groupBy("key").agg(F.min("doc_id").alias("low"))
    named = staged(lows.join(roots, F.col("key") == F.col("node"), "left").select("key", "low", F.coalesce("component", "key").alias("root")), "roots")
    discard(roots)
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = staged(named.join(best, "root").select("key", "component_id"), "of")
    discard(named)
    return names.join(of, "key").select("doc_id", "key", "component_id")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component_id) of every document, repeated rows and null ids included.

    Texts without words, null ones too, are copies of each other. Empty tables give no rows;
    other columns are not read.
    """
    return components(staged(signatures(docs, size, id_col, text_col), "signatures"), similarity)
