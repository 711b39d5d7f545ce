"""The batch jobs run continuously: each micro-batch commits the next version of the tables it changes, once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import maintenance, views
from . import store
from .store import current

__all__ = ["current", "put", "stream_patches", "stream_plans"]


def put(df: DataFrame, folder: str, table: str = "projects") -> None:
    """A table by hand, as a commit of its own."""
    store.commit(df.sparkSession, folder, {table: df}, f"put-{uuid.uuid4().hex}", 0)


def stream_plans(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Files of project rows; the rows of a source that comes again take the place of its former ones."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if store.done(session, folder, "plans", number):
            return
        old = current(session, folder)
        after = batch if old is None else old.join(batch.select("source_key").distinct(), "source_key", "left_anti").unionByName(batch, allowMissingColumns=True)
        store.commit(session, folder, {"projects": after}, "plans", number)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def patched(projects: DataFrame, briefs: DataFrame | None, patches: DataFrame, as_of: str, registry: DataFrame | None = None) -> dict[str, DataFrame]:
    """One batch of patches: the projects after it, and the briefs checked again that a patched project has a part in."""
    fields = [c for c in patches.columns if c not in ("id", "ts")]
    last = patches.groupBy("id").agg(F.max_by(F.struct(*fields), "ts").alias("p")).select("id", "p.*")
    after, _ = maintenance.apply_patches(projects, last)
    if briefs is None:
        return {"projects": after}
    return {"projects": after, "briefs": views.rechecked(briefs, after, last, as_of, registry)}


def stream_patches(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, as_of: str = "1900-01-01", registry: DataFrame | None = None) -> StreamingQuery:
    """Patches with an event time ``ts``: the last of each project in a batch is applied, and its pairs' stored briefs are checked again.

    Projects and briefs change in one commit, so that a failure between them leaves both as they were.
    """

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if not store.done(session, folder, "patches", number):
            tables = patched(current(session, folder), current(session, folder, "briefs"), batch, as_of, registry)
            store.commit(session, folder, tables, "patches", number)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
