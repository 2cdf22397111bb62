"""The registered queries of record linkage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model
from ..sources.staging import staged
from . import golden
from .linkage import STEPS, Plan, duckdb_sql
from .profiles import PROFILES

#: Steps whose rows are queries of their own under the default profile, and further steps under earlier profiles.
NAMES = {f"link_{s}": (s, "v30") for s in STEPS}
NAMES |= {f"link_{s}_{p}": (s, p) for p in ("v20", "v21", "v22", "v23", "india") for s in ("candidates", "matches")}


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that every engine shows the same values."""
    return df.select(*[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])


def _query(step: str, profile: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
        return _flat(Plan(spark, {"documents": docs}, PROFILES[profile]).step(step))

    return run


#: What a training row holds besides its source, rank, label and count: the vector's other features, in hundredths.
PACKED = tuple(c for c in model.VECTOR if c not in ("is_s2", "is_s3", "rank_feat"))


def training_rows(plan: Plan) -> DataFrame:
    """The training part of ``training_pairs`` as vectors with a label and their number ``n``.

    Features, which the trees cut into 32 parts at most, are rounded to hundredths, and equal rows are one:
    neither a group of copies nor its features are multiplied out.
    """
    packed = F.array(*[F.round(F.col(c) * 100).cast("smallint") for c in PACKED]).alias("v")
    found = plan.step("found", last=False).distinct().withColumn("label", F.lit(1))
    near = model.split(plan.step("features", last=False))[0].join(found, ["s1_id", "cand_id"], "left")
    near = near.select(packed, F.when(F.col("is_s2") == 1, "S2").otherwise("S3").alias("src"), F.col("rank_feat").cast("bigint").alias("rank_no"), F.coalesce("label", F.lit(0)).alias("label"), F.lit(1).cast("bigint").alias("n"))
    plan.step("seekers", last=False)
    looks = plan.step("looks", last=False)
    # Whatever is counted goes by the looks of first-source records, so the held-out ones leave no trace.
    learn = Plan(plan.spark, plan.frames, plan.profile)
    learn.frames["looks"] = model.split(looks.withColumn("s1_id", F.col("entity_id")).filter("src = 'S1'"))[0].drop("s1_id").unionByName(looks.filter("src <> 'S1'"))
    missed = learn.step("missed_looks", last=False)
    vectors = learn.step("look_features").select("s1_id", "cand_id", packed)
    far = vectors.join(missed, (F.col("s1_id") == F.col("x")) & (F.col("cand_id") == F.col("y"))).select("v", "src", "rank_no", F.lit(1).alias("label"), "n")
    rows = near.unionByName(far).groupBy("v", "src", "rank_no", "label").agg(F.sum("n").alias("n"))
    values = {c: F.col("v")[i] / 100.0 for i, c in enumerate(PACKED)} | {c: F.when(F.col("src") == s, 1.0).otherwise(0.0) for c, s in (("is_s2", "S2"), ("is_s3", "S3"))} | {"rank_feat": F.col("rank_no").cast("double")}
    return rows.select(*[values[c].alias(c) for c in model.VECTOR], "label", "n")


def _trained(spark: SparkSession, sf_dir: str) -> Plan:
    """A plan whose scores come from the tree ensemble, learned from the training part of the records."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    plan = Plan(spark, {"documents": docs})
    fitted = model.Ensemble.fit(staged(training_rows(plan), "training"))
    scored = fitted.score(plan.step("features", last=False))
    plan.frames["scored"] = staged(scored.select("s1_id", "cand_id", "country", "distinctiveness_score", "prob"), "scored")
    return plan


def link_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).step("scored")


def link_model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the held-out records only: neither they nor their pairs were learned from."""
    plan = _trained(spark, sf_dir)
    entities = plan.step("entities", last=False)
    held = model.split(entities.withColumn("s1_id", F.col("entity_id")))[1].drop("s1_id")
    targets = entities.filter("left(entity_id, 2) <> 'S1'")
    scored = model.split(plan.step("scored", last=False))[1]
    cands = model.split(plan.step("candidates", last=False))[1]
    shown = {"entities": held.filter("left(entity_id, 2) = 'S1'").unionByName(targets), "scored": scored, "candidates": cands, "profiles": plan.step("profiles", last=False)}
    return Plan(spark, shown).step("evaluation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (link_model_scores, link_model_evaluation)}
    return {name: _query(*of) for name, of in NAMES.items()} | golden.QUERIES | own


ARRAYS = {"legacy_records": ("long_tokens", "streets_v21", "care_of"), "records": ("name_tokens", "addr_tokens", "digits", "codes", "care_of", "stops"), "profiles": ("name_tokens", "addr_tokens", "digits", "codes", "care_of", "stops", "grams2", "grams3", "addr3", "streets")}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (step, profile) in NAMES.items():
        sql = duckdb_sql(step, PROFILES[profile])
        if step in ARRAYS:
            head, _, _ = sql.rpartition(" SELECT * FROM ")
            sql = f"{head} SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in ARRAYS[step])}) FROM {step}"
        out[name] = sql
    return out | golden.SQL
