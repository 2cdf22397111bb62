"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 13
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
#: A list of so many tokens at most (some 100 MB as a table in memory) is broadcast; a longer one is joined by shuffles.
BROADCAST_TOKENS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does just that where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Digits, letters a-z and everything beyond ASCII make words; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK, -1), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): the different windows of each item; one of fewer words, but not none, is one window. Items without an id have none."""
    words = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def prefixes(windows: DataFrame, texts: DataFrame, broadcast: int = BROADCAST_TOKENS) -> DataFrame:
    """(token, off, wid, words): each window's rarest token in all texts and where in the window it is.

    Windows with a token that no text has occur nowhere and are left out. Texts' words are
    summed up within tasks before they are shuffled; if the windows' tokens may be broadcast, only those are.
    """
    places = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "token"))
    tokens, words = staged(places.select("token").distinct(), "tokens"), texts.select(F.explode("words").alias("token"))
    count = F.count("*").alias("n")
    if tokens.count() <= broadcast:
        counts = words.join(F.broadcast(tokens), "token", "left_semi").groupBy("token").agg(count)
    else:
        counts = words.groupBy("token").agg(count).join(tokens, "token", "left_semi")
    ranked = places.join(counts, "token")
    best = ranked.groupBy("wid", "size").agg(F.min(F.struct("n", "token", "off")).alias("p"), F.count("*").alias("found")).filter("found = size")
    return best.select(F.col("p.token").alias("token"), F.col("p.off").alias("off"), "wid").join(windows, "wid")


def covered(spans: Column) -> Column:
    """How many words are in at least one of the sorted spans (start, end)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, zero, lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(a.upto, s.start))).alias("n"), F.greatest(a.upto, s.end).alias("upto")), lambda a: a.n)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), broadcast: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every document row.

    A window can only occur where its rarest token does: its necessary prefix when tokens
    are ordered by rarity in the whole corpus and every token must match. Different windows are
    joined, whichever items have them. Texts yield the places of their words, and nothing else;
    those of prefix tokens meet the windows, must leave room before and after (positional and
    length bounds), and come to the text once, where the words themselves are compared. Words inside
    any occurrence are hit. Lists of tokens are broadcast up to ``broadcast`` of them; beyond, the
    same joins shuffle. Copies of a text, told by two hashes, are searched once.

    Nulls and empty texts have no words and are clean; items without words or id have no
    windows; repeated rows stay apart. ``carry`` names further columns to keep.
    """
    each = staged(item_windows(items, window).withColumn("wid", F.xxhash64("words")), "windows")
    windows = staged(each.select("wid", "words").distinct(), "different")
    marks = (F.xxhash64(text_col).alias("t1"), F.xxhash64(text_col, F.lit("second")).alias("t2"))
    texts = docs.select(*marks, words_of(F.col(text_col)).alias("words"))
    probes = staged(prefixes(windows, texts, broadcast), "probes")
    spots = texts.select("t1", "t2", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "token"))
    keys = probes.select("token").distinct()
    if probes.count() <= broadcast:
        spots = spots.join(F.broadcast(keys), "token", "left_semi")
    start, size = F.col("at") - F.col("off"), F.size("words")
    met = spots.join(probes, "token").filter((start >= 0) & (start + size <= F.col("n_words"))).select("t1", "t2", start.alias("start"), "wid", "words").distinct()
    asked = staged(met.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "wid", "words")).alias("asked")), "asked")
    own = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry], *marks, F.col(text_col).alias("__text"))
    whole = own.join(asked, ["t1", "t2"], "left").withColumn("words", words_of(F.col("__text")))  # texts move, their words would take twice the room
    fits = F.filter("asked", lambda a: F.slice("words", a["start"] + 1, F.size(a["words"])) == a["words"])
    hits = F.transform(fits, lambda a: F.struct(a["start"].alias("start"), (a["start"] + F.size(a["words"])).alias("end"), a["wid"].alias("wid"), F.xxhash64(a["words"], F.lit("second")).alias("second")))
    judged = whole.select("doc_id", *carry, "t1", "t2", F.size("words").cast("long").alias("n_words"), F.when(F.size("asked") > 0, hits).alias("hits"))
    rows = staged(judged.withColumn("spans", F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))))).select("doc_id", *carry, "t1", "t2", "n_words", F.when(F.size("spans") > 0, covered(F.col("spans"))).otherwise(F.lit(0)).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: F.struct(h["wid"].alias("wid"), h["second"].alias("second")))).alias("found")), "judged")
    # Items by text, not by row, so that copies cost nothing.
    found = rows.filter("n_hit > 0").groupBy("t1", "t2").agg(F.min("found").alias("found")).select("t1", "t2", F.explode("found").alias("w")).select("t1", "t2", F.col("w.wid").alias("wid"), F.col("w.second").alias("second"))
    owners = each.select("wid", F.xxhash64("words", F.lit("second")).alias("second"), "item_id")
    names = found.join(owners, ["wid", "second"]).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = rows.drop("found").join(names, ["t1", "t2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", *carry, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"))
