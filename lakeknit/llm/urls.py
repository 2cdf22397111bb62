"""URL filters: path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the Bloom filter for each listed URL, and how many of them a URL sets, all in one block of 64.
BITS_PER_URL = 16
PROBES = 4
#: A filter of at most so many blocks (16 bytes each) is broadcast; a larger one is joined by its blocks.
BROADCAST_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_hit(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    """Whether a rule fits: its host or a subdomain, and a path that starts with the rule's."""
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]], value: list[str]) -> Column:
    """The value of the longest rule that fits; of equally long ones, the last by name."""
    out = F.lit(None).cast("string")
    for (h, p), v in sorted(zip(rules, value, strict=True), key=lambda x: (len(x[0][0] + x[0][1]), x[0])):
        out = F.when(rule_hit(host, path, h, p), F.lit(v)).otherwise(out)
    return out


def canonical_host(host: Column) -> Column:
    """A host without user, port, and dots at its ends, A-Z lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, LOWER), r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\.+|\.+$", ""), r"\.{2,}", ".")


def canonical_path(path: Column) -> Column:
    """A path that begins with one slash, without repeated slashes and ``.`` folders; ``..`` folders take the one before away."""
    flat = F.regexp_replace(F.concat(F.lit("/"), path), "/{2,}", "/")
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    # The last part stays a file, but for dots, which are folders.
    named = F.regexp_replace(flat, r"(/\.{1,2})$", "$1/")
    folded = F.aggregate(F.slice(F.split(named, "/"), F.lit(2), F.size(F.split(named, "/"))), none, step)
    return F.when(flat.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(flat)


def listed_entries(listed: DataFrame, url_col: str = "url") -> DataFrame:
    """(entry, labels, folders): the distinct canonical URLs of a list, with or without scheme, and how deep they are.

    Null entries and those without a host name nothing.
    """
    whole = F.regexp_replace(F.trim(F.col(url_col)), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = listed.select(canonical_host(F.regexp_extract(whole, r"^([^/?#]*)", 1)).alias("h"), canonical_path(F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)).alias("p")).filter("h <> ''")
    return parts.select(F.concat("h", "p").alias("entry"), F.size(F.split("h", r"\.")).alias("labels"), (F.size(F.split("p", "/")) - 1).alias("folders")).distinct()


def lookups(host: Column, path: Column, labels: int, folders: int) -> Column:
    """The canonical URLs under which a page may be listed: its host and all parent domains, each with the path and all its folders.

    Only as deep as the list is: ``labels`` and ``folders`` are the most that an entry has.
    """
    own, n = F.split(host, r"\."), F.size(F.split(host, r"\."))
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(own, n - k + 1, k), "."))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(folders))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(F.array(path), above))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _mask(url: Column) -> Column:
    h = F.xxhash64(url, F.lit("mask"))
    return F.aggregate(F.array(*[F.lit(6 * i) for i in range(PROBES)]), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def filter_blocks(n: int) -> int:
    """Blocks of 64 bits for a list of ``n`` URLs."""
    return max(64, -(-n * BITS_PER_URL // 64))


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, mask): a word of 64 bits for each block that a listed URL falls into."""
    return entries.groupBy(_block(F.col("entry"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("entry"))).alias("mask"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page.

    rules: (verdict, host, path); the longest that fits decides. Else a page is blocked if
    its canonical URL is listed, or a folder above it, or either of a parent domain; an
    entry that ends with a slash is a folder. The Bloom filter, which is as large as the list needs, sorts
    out most pages; only URLs that may be listed, without repetition, meet the list
    in an exact join, which removes false positives.

    Null and malformed URLs have empty parts and no rule, and are allowed; repeated rows and
    null ids stay; very long URLs are looked up no deeper than the list is; an empty list blocks
    nothing; other columns of either table are not read.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    parts = slim.select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    names = [(h, p) for _, h, p in rules]
    ruled = parts.withColumns({"rule": best_rule(F.col("host"), F.col("path"), names, [h + p for h, p in names]), "ruled": best_rule(F.col("host"), F.col("path"), names, [v for v, _, _ in rules])})
    entries = listed_entries(listed.select(F.col(list_col).alias("url")))
    # One row: the size of the list and how deep it goes.
    n, labels, folders = entries.agg(F.count("*"), F.coalesce(F.max("labels"), F.lit(1)), F.coalesce(F.max("folders"), F.lit(1))).first()
    blocks = filter_blocks(n)
    urls = ruled.filter("ruled IS NULL AND host <> ''").select("host", "path").distinct()
    keys = urls.withColumn("entry", F.explode(lookups(canonical_host(F.col("host")), canonical_path(F.col("path")), labels, folders)))
    sieve = bloom(entries, blocks)
    maybe = keys.withColumn("block", _block(F.col("entry"), blocks)).join(F.broadcast(sieve) if blocks <= BROADCAST_BLOCKS else sieve, "block").filter(F.col("mask").bitwiseAND(_mask(F.col("entry"))) == _mask(F.col("entry")))
    hits = maybe.join(entries, "entry", "left_semi").select("host", "path").distinct().withColumn("listed", F.lit(True))
    out = ruled.join(hits, ["host", "path"], "left")
    seen = F.coalesce("listed", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(seen, "block").otherwise("allow")).alias("verdict"), seen.alias("listed"))
