"""Physical layout of a run as relations: entry sizes, blocks, index, footer, floor lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.bloom import filter_bytes, optimal_bits
from keystrata.model import ENTRIES_PER_BLOCK, ENTRY_HEADER_BYTES, FOOTER_BYTES
from keystrata.operators.ordered import ranged, running_sums


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    """Encoded size of an entry: fixed header, key and value bytes."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + ENTRY_HEADER_BYTES).cast("long")


def offsets(rows: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Byte offset of each entry in its file (one file per value of by)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bytes", entry_bytes()).withColumn("offset", F.coalesce(F.sum("bytes").over(w), F.lit(0)).cast("long"))


def blocks(run_rows: DataFrame) -> DataFrame:
    """Rows of runs (column run), numbered in key order and put into blocks of 64."""
    w = Window.partitionBy("run").orderBy("key")
    placed = run_rows.withColumn("bytes", entry_bytes()).withColumns(
        {"rn": F.row_number().over(w).cast("long"), "offset": F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")}
    )
    return placed.withColumn("block", F.floor((F.col("rn") - 1) / ENTRIES_PER_BLOCK).cast("long"))


def blocks_of_one(rows: DataFrame) -> DataFrame:
    """The same for the rows (key, value) of one run of any size, which no task has to hold."""
    sized = rows.withColumn("bytes", entry_bytes()).withColumn("_one", F.lit(1))
    summed = running_sums(ranged(sized, "key"), {"rn": "_one", "_end": "bytes"})
    placed = summed.withColumns({"offset": F.col("_end") - F.col("bytes"), "block": F.floor((F.col("rn") - 1) / ENTRIES_PER_BLOCK).cast("long")})
    return placed.drop("_one", "_end")


def block_index(placed: DataFrame) -> DataFrame:
    """Per block: first key, byte offset, entries."""
    return placed.groupBy("run", "block").agg(F.min("key").alias("first_key"), F.min("offset").alias("block_offset"), F.count("*").alias("entries"))


def run_metadata(run_rows: DataFrame) -> DataFrame:
    """Per run: smallest and largest key, entries, data bytes."""
    return run_rows.groupBy("run").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entries"), F.sum(entry_bytes()).alias("data_bytes"))


def footers(run_rows: DataFrame, rate: float) -> DataFrame:
    """Per run: filter and index offsets, entry count, footer offset, file size (closed forms)."""
    index = block_index(blocks(run_rows)).groupBy("run").agg((F.lit(4) + F.sum(F.octet_length("first_key") + 8)).cast("long").alias("index_bytes"), F.count("*").alias("blocks"))
    meta = run_metadata(run_rows).join(index, "run")
    filter_off, filt = F.col("data_bytes"), filter_bytes(optimal_bits(F.col("entries"), rate))
    index_off = filter_off + filt
    footer_off = index_off + F.col("index_bytes")
    return meta.select(
        "run", "entries", "blocks", filter_off.cast("long").alias("filter_offset"), index_off.cast("long").alias("index_offset"), footer_off.cast("long").alias("footer_offset"), (footer_off + FOOTER_BYTES).cast("long").alias("file_bytes")
    )


def floor_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key the block whose first key is the greatest one not above it; none before the first.

    index and probes share column run. The index rows and the probes are merged in key order within the
    run and the last index row seen is carried forward: one sort, no range join.
    """
    w = Window.partitionBy("run").orderBy("k", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = index.select("run", F.col("first_key").alias("k"), F.lit(0).alias("is_probe"), "block", "block_offset").unionByName(
        probes.select("run", F.col("key").alias("k"), F.lit(1).alias("is_probe"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("block_offset"))
    )
    carried = merged.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("block", "block_offset")})
    return carried.where("is_probe = 1").select("run", F.col("k").alias("key"), "block", "block_offset")


def run_overlap(meta: DataFrame) -> DataFrame:
    """Pairs of runs whose key intervals meet. The input is metadata, one row per run."""
    a = meta.select(F.col("run").alias("run_a"), F.col("smallest").alias("lo_a"), F.col("largest").alias("hi_a"))
    b = meta.select(F.col("run").alias("run_b"), F.col("smallest").alias("lo_b"), F.col("largest").alias("hi_b"))
    return a.join(b, (F.col("run_a") < F.col("run_b")) & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))).select("run_a", "run_b")


def read_amplification(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """Runs that a miss-free read of each key would open: all of them, and those whose interval holds it.

    The runs that hold a key are those begun at it or before, less those ended before it: the bounds and the
    keys are put in one order, and a running sum counts them.
    """
    bounds = meta.select(F.col("smallest").alias("key"), F.lit(0).alias("_kind"), F.lit(1).alias("_step"), F.lit(1).alias("_run"))
    bounds = bounds.unionByName(meta.select(F.col("largest").alias("key"), F.lit(2).alias("_kind"), F.lit(-1).alias("_step"), F.lit(0).alias("_run")))
    placed = ranged(bounds.unionByName(keys.select("key", F.lit(1).alias("_kind"), F.lit(0).alias("_step"), F.lit(0).alias("_run"))), "key", "_kind")
    total = placed.agg(F.coalesce(F.sum("_run"), F.lit(0)).alias("runs_total"))
    counted = running_sums(placed, {"runs_in_range": "_step"}).where("_kind = 1").select("key", "runs_in_range")
    return counted.crossJoin(F.broadcast(total))
