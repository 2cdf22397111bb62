"""The corpus pipeline: quality, near duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeknit.llm import bpe, common, decontaminate, pii, quality, similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower quality score go.
KEEP_FROM = 0.5
#: SQL can't express the classifier, the fingerprints, the trees or the merges.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for them; learned from labelled rows of the documents given.

    Labels of every row may be used here: nothing is held out. Without labels all stay. Null
    and empty texts are scored like any other; repeated rows and null ids are judged alike and stay
    or go together. Extra columns are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    return quality.keep_documents(docs.select(*COLUMNS), model, KEEP_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one of the smallest id; of rows that repeat its id and text, the smallest.

    Similar: five-word shingles with a similarity of 0.8 or more. Rows of equal ids and
    different texts are different documents. A group keeps a document without an id only if
    none has one, the one whose text has the smallest hash. Extra columns are dropped.
    """
    marked = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).alias("row"))
    found = common.staged(similar.similar_documents(marked, id_col="row"), "similar")
    keep = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id.id").alias("kid"), F.col("doc_id.th").alias("kth"), "n")
    kept = marked.join(keep, F.expr("row.th = kth AND row.id <=> kid"))
    single, several = kept.filter("n = 1"), kept.filter("n > 1")
    first = several.groupBy("kid", "kth").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return single.select(*COLUMNS).union(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold enough words of benchmark items; judged for each row.

    Null and empty texts hold none and stay, as do all where the benchmark is empty; repeated rows and
    null ids are judged alike. Extra columns are dropped.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked = docs.withColumn("__th", F.xxhash64("text"))
    found = decontaminate.decontaminate(marked, items, carry=("__th",))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("__th").alias("bad_th")).distinct()
    return marked.join(bad, F.expr("__th = bad_th AND doc_id <=> bad_id"), "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars follows the new text.

    A null text stays null, with a null n_chars. Repeated rows and null ids stay. Extra columns are dropped.
    """
    found = pii.find(docs, pii.fit(spark), carry=("lang", "source"))
    out = found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; see the operator's query.

    Null texts count as empty: no tokens. Repeated rows and null ids stay, each a row.
    """
    import public_tokenizers

    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", redact), ("tokens", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
