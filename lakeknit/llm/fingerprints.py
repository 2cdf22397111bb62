"""Document fingerprints: a wide digest of the canonical text, with byte comparison where digests are equal."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_documents, slices, spark_schema_to_arrow, staged


def canonical(text: str) -> bytes:
    """NFKC, case folding, NFKC again, and one blank between words."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints of equal canonical bytes, else 0."""
    return float(digest(a) == digest(b) and a == b)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null counts as empty. Nothing is shuffled."""

    def one(data: bytes) -> tuple[int, str]:
        text = data.decode()
        return len(text), digest(canonical(text))

    return map_documents(docs, lambda: lambda texts: [one(t or b"") for t in texts], "n_chars long, fingerprint string", id_col, text_col)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, same): groups of documents with equal canonical texts.

    A bucket is a fingerprint; its smallest id's canonical bytes are what the others'
    are compared with, by an equi-join whose hot buckets can be split. ``same`` is false for
    a document whose bytes differ in spite of equal digests. Null ids never name a bucket
    that has another id; repeated rows stay.
    """
    kind = dict(docs.dtypes)[id_col]

    def one(data: bytes) -> tuple[str, bytes]:
        form = canonical(data.decode())
        return digest(form), form

    forms = staged(map_documents(docs, lambda: lambda texts: [one(t or b"") for t in texts], "fingerprint string, form binary", id_col, text_col), "forms")
    first = forms.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "form")).alias("x")).select("fingerprint", F.col("x.form").alias("first"))
    return forms.join(first, "fingerprint").select(F.col("doc_id").cast(kind).alias("doc_id"), "fingerprint", (F.col("form") == F.col("first")).alias("same"))


#: A row of the ordered pass: complete, or the last or first document of a partition with its text.
FULL, TAIL, HEAD = 0, 1, 2
_EDITS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, after: str) -> str:
    """The text whose last half is replaced by the beginning of another one."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def compare(text: str, after: str) -> tuple:
    """The columns of _EDITS for a text and the one that follows it."""
    changed = edit(text, after)
    own, new, following = canonical(text), canonical(changed), canonical(after)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, following)


def compare_neighbours(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its text with the next one's beginning, and their likenesses.

    The next document is the one with the next smaller id; after the last comes the first.
    Null ids come last, equal ids by text; null texts count as empty. One shuffle by ranges
    of ids brings neighbours together; only the documents at the ranges' ends are joined.
    """
    kind = dict(docs.dtypes)[id_col]
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    # The text splits ranges of null or repeated ids, too.
    placed = slim.repartitionByRange(n, order, "text").sortWithinPartitions(order, "text")
    schema = f"part int, kind int, doc_id {kind}, {_EDITS}, text string"
    fields = spark_schema_to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

        none = (None,) * 6
        for batch in slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None:
                    rows.append((part, HEAD, None, *none, text))
                else:
                    rows.append((part, FULL, held[0], *compare(held[1], text), None))
                held = (key, text)
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(part, TAIL, held[0], *none, held[1])])

    rows = staged(placed.mapInArrow(run, schema), "neighbours")
    # One row for each partition: its number, and the number of the next one that has rows.
    parts = rows.filter(F.col("kind") == HEAD).select("part")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("next"))
    heads = rows.filter(F.col("kind") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = rows.filter(F.col("kind") == TAIL).select("part", "doc_id", "text").join(turn, "part").join(heads, "next").select("doc_id", "text", "after")
    ends_fields = spark_schema_to_arrow(docs.sparkSession, f"doc_id {kind}, {_EDITS}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            got = [(k, *compare(t, a)) for k, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), ends_fields, strict=True)], schema=pa.schema(ends_fields))

    ends = tails.mapInArrow(finish, f"doc_id {kind}, {_EDITS}")
    return rows.filter(F.col("kind") == FULL).drop("part", "kind", "text").unionByName(ends)
