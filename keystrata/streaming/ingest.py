"""Streams of mutations: exactly-once ingestion in micro-batches, and a continuously updated state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.model import PUT
from keystrata.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", order: str = "ord", **trigger) -> StreamingQuery:
    """Writes a stream of (ord, op, key, value) into the store; a replayed micro-batch is skipped.

    trigger is passed to DataStreamWriter.trigger; processingTime plays the group-commit timeout's part.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, order, stream=name, batch_id=batch_id)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_state(stream: DataFrame) -> DataFrame:
    """The current state of a stream of (seq, op, key, value); use it with output mode complete or update."""
    top = stream.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return top.select("key", "m.seq", "m.op", "m.value").where(F.col("op") == PUT)


def mutation_rate(stream: DataFrame, time: str, window: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """Puts and deletes per event-time window; rows later than the watermark are left out."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"))
    return w.agg(F.count_if(F.col("op") == 0).alias("puts"), F.count_if(F.col("op") == 1).alias("deletes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "puts", "deletes")
