"""The registered queries of the corpus operators, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, langid, pii, quality, simhash, substrings, toxicity, urls
from .common import crc_mod

#: Path rules: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A table of listed URLs (column ``url``) that a session may name, and the list without one: sites that advertise or trap, by topic.
URL_LIST = "lakeknit.url.list"
TOPICS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "click-pay", "fake-shop", "free-bets", "malware-drop", "phish-login", "spam-farm")
LISTED = [f"{name}.example.{top}/" for name in TOPICS for top in ("com", "net", "org", "info", "biz")] + [f"www.example.{top}/{folder}/" for top in ("info", "biz") for folder in ("ads", "trackers")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def listed_urls(spark: SparkSession) -> DataFrame:
    path = spark.conf.get(URL_LIST, None)
    if path:
        return spark.read.parquet(path).select("url")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("url"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed_urls(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored(docs: DataFrame, scored: DataFrame, held_out: int, parts: int) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(crc_mod("doc_id", parts) == held_out, F.lit(False)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return _scored(docs, quality.classify(docs, model), 1, 3).select("doc_id", "held_out", "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir), pii.fit(spark))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def _is(kind: int) -> Callable:
    return lambda s: s["k"] == kind


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return _scored(docs, toxicity.classify(docs, model), 0, 5).select("doc_id", "held_out", "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return _scored(docs, langid.identify(docs, model), 2, 4).select("doc_id", "held_out", "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trips(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_url_filters, op3_simhash, op4_quality, op5_pii, op6_fingerprints, op7_toxicity, op8_language, op9_bpe, op10_decontamination)}
