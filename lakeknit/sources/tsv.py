"""Tab-separated sources, truth and results of record linkage; columns are bound by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def _read(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    raw = spark.read.csv(paths, sep="\t", header=True, schema=schema, quote="", enforceSchema=False)
    return raw.select(*[F.coalesce(F.trim(c) if c.endswith("_id") else F.col(c), F.lit("")).alias(c) for c in schema.names])


def read_sources(spark: SparkSession, *paths: str, default_country: str = "US") -> DataFrame:
    """Records of one or more files with a header; missing values are empty, rows without an id go, a missing country is the default."""
    rows = _read(spark, list(paths), SOURCE).filter("entity_id <> ''")
    return rows.withColumn("country", F.when(F.trim("country") == "", default_country).otherwise(F.col("country")))


def read_truth(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(s1_id, cand_ids, stratum): the true matches of each record; stratum is their number, 4 at most."""
    rows = _read(spark, [path], TRUTH).filter("source1_entity_id <> ''")
    rows = rows.orderBy("source1_entity_id").limit(limit) if limit is not None else rows
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda v: F.trim(v)), lambda v: v != "")
    return rows.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("cand_ids")).withColumn("stratum", F.least(F.size("cand_ids"), F.lit(4)))


def read_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """The distinct ids of source files, from their first column alone."""
    return read_sources(spark, *paths).select("entity_id").distinct()


def partition_by_country(records: DataFrame, path: str) -> None:
    """Parquet with one folder a country, any country, which several tasks write; later reads of some countries open only their folders."""
    records.repartition("country", F.pmod(F.xxhash64("entity_id"), F.lit(16))).write.mode("overwrite").partitionBy("country").parquet(path)


def read_countries(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("country").isin(countries)) if countries is not None else rows


def write_results(results: DataFrame, folder: str) -> None:
    """The two result tables as tab-separated text with headers: matches by id, candidates by rank, nothing for none."""
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        out = results.select("source1_entity_id", column)
        out.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True, quote="", emptyValue="", nullValue="")


def stage_countries(old: DataFrame, new: DataFrame, replaced: list[str]) -> DataFrame:
    """Older results but for the countries that are replaced, and the new rows of those."""
    return old.filter(~F.col("country").isin(replaced)).unionByName(new.filter(F.col("country").isin(replaced)))


def check_file(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(finding, n) of a result file itself: a missing or empty file, a wrong or comma header, rows without a tab; blank lines don't count."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([("missing_file", 1)], "finding string, n long")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    header = f"source1_entity_id\t{column}"
    head = F.col("value").startswith("source1_entity_id")
    tests = {
        "empty_file": (F.count("*") == 0).cast("long"),
        "comma_header": F.coalesce(F.sum((head & F.col("value").contains(",")).cast("long")), F.lit(0)),
        "wrong_header": F.coalesce((F.sum((F.col("value") == header).cast("long")) == 0).cast("long"), F.lit(1)),
        "malformed_rows": F.coalesce(F.sum((~F.col("value").contains("\t")).cast("long")), F.lit(0)),
    }
    found = lines.agg(*[v.cast("long").alias(k) for k, v in tests.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("n")) for k in tests])).alias("x")).select("x.*")


def package(results: DataFrame, verdict: DataFrame, folder: str) -> str:
    """Write the result tables and a summary below ``folder`` and name it; refuse results that fail their checks.

    The tables stay a folder of files each, as many as tasks wrote them, so nothing passes through the driver but the verdict's one row.
    """
    said = verdict.first()
    if said is None or said["verdict"] != "PASS":
        raise ValueError(f"the results fail their checks: {said}")
    write_results(results, folder)
    ids = F.filter(F.split("matched_entity_ids", ","), lambda v: v != "")
    claimed = results.select(F.explode(ids).alias("id")).groupBy("id").count()
    audit = claimed.agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("collisions"))
    shares = results.agg(F.count("*").alias("n_rows"), F.avg((F.size(ids) == 0).cast("double")).alias("singleton_share"), F.avg(F.size(ids).cast("double")).alias("avg_matches"))
    shares.crossJoin(audit).write.mode("overwrite").json(f"{folder}/summary")  # one row by one row
    return folder
