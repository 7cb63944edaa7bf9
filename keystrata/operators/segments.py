"""Write-side structure: group commit, memtable sequence numbers, flush segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.ordered import PART, PLACE, ranged, with_previous


def batch_number(seq: Column, size: int) -> Column:
    """The group-commit batch of a mutation when batches fill up."""
    return F.floor((seq - 1) / size).cast("long")


def group_commit(log: DataFrame, size: int) -> DataFrame:
    """Per batch: entries, first and last sequence number."""
    return log.groupBy(batch_number(F.col("seq"), size).alias("batch")).agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def run_number(seq: Column, size: int) -> Column:
    """Bulk segmentation: every size mutations make a run."""
    return F.floor((seq - 1) / size).cast("long")


def local_seq(log: DataFrame, run: Column) -> DataFrame:
    """Sequence numbers that restart at 1 in each memtable, beside the global ones.

    Global numbers are dense within a run, so the run's minimum is enough; no per-run sort is needed.
    """
    tagged = log.withColumn("run", run)
    first = tagged.groupBy("run").agg(F.min("seq").alias("first_seq"))
    return tagged.join(first, "run").select("run", "seq", (F.col("seq") - F.col("first_seq") + 1).alias("local_seq"), "key")


#: Rows of one group while segments are carried to the mutations.
SPREAD = 1 << 16


def segment_starts(log: DataFrame, threshold: int, batch_size: int = 1, shard: str | None = None) -> DataFrame:
    """(segment, start): the first mutation of each memtable generation, with the shard if there is one.

    The threshold is tested once per batch of batch_size mutations, before the batch is applied. That is a
    state machine over the log's order. Keys are first reduced to one row per batch, side by side; then one
    task per shard walks over them as a stream, with threshold + batch_size keys of state at most, and gives
    a row per segment.
    """
    by = [shard] if shard else []
    batch = batch_number(F.col("seq"), batch_size)
    reduced = log.groupBy(*by, batch.alias("batch"), "key").agg(F.min("seq").alias("seq"))
    first = log.groupBy(*by, batch.alias("batch")).agg(F.min("seq").alias("start")) if batch_size > 1 else None
    head = f"{shard} {log.schema[shard].dataType.simpleString()}, " if shard else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now, keys, segment = object(), None, set(), 0
        for b in batches:
            found = []
            for s, n, k, q in zip(b[shard] if shard else [None] * len(b), b["batch"], b["key"], b["seq"], strict=True):
                if s != current:
                    current, now, keys, segment = s, n, set(), 0
                    found.append((s, 0, n, q))
                elif n != now:
                    now = n
                    if len(keys) >= threshold:
                        keys, segment = set(), segment + 1
                        found.append((s, segment, n, q))
                keys.add(bytes(k) if isinstance(k, bytearray) else k)
            yield pd.DataFrame(found, columns=[shard or "_none", "segment", "batch", "start"])[[*by, "segment", "batch", "start"]]

    dealt = reduced.repartition(shard) if shard else reduced.repartition(1)
    starts = dealt.sortWithinPartitions(*by, "batch", "seq").mapInPandas(run, f"{head}segment long, batch long, start long")
    if first is None:
        return starts.drop("batch")
    return starts.drop("start").join(first, [*by, "batch"]).select(*by, "segment", "start")


def flush_segments(log: DataFrame, threshold: int, shard: str | None = None, batch_size: int = 1) -> DataFrame:
    """Adds segment: the memtable generation each mutation falls into (see segment_starts).

    The starts are merged with the mutations in groups of SPREAD sequence numbers, and the last start seen
    is carried forward; a segment that goes over several groups has a row in each of them.
    """
    by = [shard] if shard else []
    group = F.floor(F.col("seq") / SPREAD)
    # The walk is done once: its rows are read for the starts and for the ends.
    starts = segment_starts(log, threshold, batch_size, shard)
    after = F.lead("start").over(Window.partitionBy(*by).orderBy("segment") if by else Window.partitionBy(F.lit(0)).orderBy("segment"))
    last = log.groupBy(*by).agg(F.max("seq").alias("_end"))
    spans = starts.withColumn("_next", after - 1).join(F.broadcast(last), by, "left") if by else starts.withColumn("_next", after - 1).crossJoin(F.broadcast(last))
    marks = spans.select(*by, "segment", "start", F.explode(F.sequence(F.floor(F.col("start") / SPREAD), F.floor(F.coalesce("_next", "_end") / SPREAD))).alias("_group"))
    rows = log.withColumns({"_group": group, "_mark": F.lit(1), "segment": F.lit(None).cast("long")})
    carried = rows.unionByName(marks.select(*by, "_group", "segment", F.greatest("start", F.col("_group") * SPREAD).alias("seq"), F.lit(0).alias("_mark")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_group").orderBy("seq", "_mark", "segment").rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn("segment", F.last("segment", ignorenulls=True).over(w)).where("_mark = 1").select(*log.columns, "segment")


def keep_last(commands: DataFrame, limit: int, order: str = "ord", text: str = "cmd") -> DataFrame:
    """Command history: consecutive repeats go, then the last limit entries stay.

    Rows are dealt by range; each partition compares its own neighbours, and its first row with the last
    one of the partition before.
    """
    stored = with_previous(ranged(commands, order), text, "_prev")
    first = (F.col(PART) == 0) & (F.col(PLACE) == 0)
    kept = stored.where(first | ~F.col("_prev").eqNullSafe(F.col(text))).select(*commands.columns)
    return kept.orderBy(F.desc(order)).limit(limit).orderBy(order)
