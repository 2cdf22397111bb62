"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import release

#: A class of training rows has at most so many documents, and as many as have so many characters together; all classes together have at most FIT_ROWS.
FIT_PER_CLASS = 500
FIT_CHARS = 8_000_000
FIT_ROWS = 10_000
#: Rows that a worker turns into Python objects at a time.
SLICE_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeknit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read, not a second run of the work above.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakeknit-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a staged table once everything made of it is staged itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_documents(docs: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], columns: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: its id, and what ``make()(texts)`` returns for its text.

    ``make`` runs once in each task; the function that it returns gets a batch of
    texts as bytes (None: null) and returns a tuple of values for each.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, {columns}"
    spark = docs.sparkSession
    arrow = spark_schema_to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            rows = work(utf8(batch.column(1)))
            parts = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), *(pa.array(p, type=f.type) for p, f in zip(parts, arrow[1:], strict=True))], schema=pa.schema(arrow))

    return slim.mapInArrow(run, schema)


def spark_schema_to_arrow(spark: SparkSession, schema: str) -> list[pa.Field]:
    """The Arrow fields of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_lakeknit_worker", types.ModuleType("_lakeknit_worker"))
    return module.__dict__.setdefault(name, {})


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod ``m``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def fit_sample(docs: DataFrame, label: str, learn: Column, id_col: str, text_col: str, per_class: int = FIT_PER_CLASS) -> list[tuple]:
    """(label, text) of the rows that ``fit_rows`` chooses, on the driver."""
    return by_id(fit_rows(docs, label, learn, id_col, text_col, per_class).collect())


def by_id(rows: Iterable[tuple]) -> list[tuple]:
    """(label, text) of rows of label, text and id, in the order of ids; of repeated ids the last."""
    unique = {r[2]: (r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], str(r[0]), r[1]))}
    return [unique[k] for k in sorted(unique)]


def fit_rows(docs: DataFrame, label: str, learn: Column, id_col: str, text_col: str, per_class: int = FIT_PER_CLASS) -> DataFrame:
    """Label, text and id of at most ``per_class`` rows for each label, by the order of the id's hash.

    ``learn`` says which rows may be used; texts of any length may, as long as a class has no
    more than FIT_CHARS characters. Only ids are ordered; their texts come by a join with that bounded list.
    """
    from pyspark.sql import Window

    rows = docs.filter(learn & F.col(label).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    classes = rows.select(label).distinct().count()
    per_class = max(1, min(per_class, FIT_ROWS // max(1, classes)))
    chars = max(1, min(FIT_CHARS, 2 * FIT_CHARS // max(1, classes)))
    order = ("__hash", "__id")
    size = F.col("__fit_chars") if "__fit_chars" in docs.columns else F.length(text_col)
    ids = rows.select(F.col(label).alias("__label"), F.xxhash64(id_col).alias("__hash"), F.col(id_col).alias("__id"), size.alias("__n"))
    # First within 64 parts of each class, so that no task gets more than a bounded number of rows from each part.
    part = F.row_number().over(Window.partitionBy("__label", F.pmod("__hash", F.lit(64))).orderBy(*order))
    some = ids.withColumn("__rank", part).filter(F.col("__rank") <= per_class).drop("__rank")
    whole = Window.partitionBy("__label").orderBy(*order)
    ranked = some.withColumn("__rank", F.row_number().over(whole)).filter(F.col("__rank") <= per_class)
    few = ranked.withColumn("__sum", F.sum("__n").over(whole)).filter(F.col("__sum") <= chars).select("__id").distinct()
    return rows.join(F.broadcast(few), F.col(id_col) == F.col("__id"), "left_semi").select(label, text_col, id_col)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), staged, for the nodes of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each keeps one edge for a node and
    neighbour, so no group is ever gathered, and a hot centre is only one side of an equi-join.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = staged(both, "edges")
    while True:
        sym = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = staged(small, "edges")
        discard(current)
        current = after
        # Settled when the edges form stars: every node has one centre, and no centre has one.
        many = after.groupBy("u").count().filter("count > 1").limit(1)
        chain = after.join(after.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1)
        if many.union(chain.select("u", F.lit(1).cast("long"))).isEmpty():
            break
    out = staged(after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(after)
    return out
