"""First-source records as a stream against the targets' keys: each micro-batch runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.linkage import Plan
from ..plans.profiles import V30, Profile
from ..sources.staging import staged


def link_stream(records: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, profile: Profile = V30, step: str = "candidates") -> StreamingQuery:
    """Start a query that hands ``step``'s rows for each micro-batch of ``records`` to ``sink``.

    Targets are normalised and keyed once, before the query starts. Both frames have the columns of the ``entities`` step. A batch that is run again
    after a failure gives the same rows, so a sink that overwrites by batch id is exact.
    """

    # Stop words come from the targets alone and are fixed for the query, so that a record's keys don't depend on its batch.
    known = Plan(targets.sparkSession, {"entities": targets}, profile)
    tables = {name: staged(known.step(name, last=False), f"stream-{name}") for name in ("stopwords", "profiles", "keys")}
    # Batches run in a session of their own, which reads the tables again.
    places = {name: (t.schema, sorted({f.rpartition("/")[0] for f in t.inputFiles()})) for name, t in tables.items()}

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shared = {name: spark.read.schema(schema).parquet(*paths) for name, (schema, paths) in places.items()}
        own = Plan(spark, {"entities": batch, "stopwords": shared["stopwords"]}, profile)
        both = {name: own.step(name, last=False).unionByName(shared[name]) for name in ("profiles", "keys")}
        plan = Plan(spark, {"entities": batch.unionByName(targets), **both}, profile)
        sink(plan.step(step), number)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
