"""Latest mutation per key wins; tombstones hide the key.

Everything the store reads is a thin composition over :func:`latest`: one hash partitioning on the key,
with a partial aggregate in front of it, so a hot key costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.model import DELETE, DUMP_KEY_WIDTH, PUT


def latest(log: DataFrame, upto: int | None = None, keep_tombstones: bool = False) -> DataFrame:
    """Rows (key, seq, op, value): the mutation of each key with the greatest seq.

    upto reads the state as of that sequence number. The newest mutation is found as the maximum of a
    struct that starts with seq, which aggregates partially before the exchange.
    """
    src = log if upto is None else log.where(F.col("seq") <= upto)
    top = src.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    out = top.select("key", "m.seq", "m.op", "m.value")
    return out if keep_tombstones else out.where(F.col("op") == PUT)


def point_get(log: DataFrame, key) -> DataFrame:
    """The live value of one key: no row if absent or deleted. The key filter reaches the scan."""
    return latest(log.where(F.col("key") == F.lit(key))).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Status (FOUND, DELETED or ABSENT) and value for every row of keys (column key)."""
    wanted = keys.select("key").distinct()
    state = latest(log.join(wanted, "key", "left_semi"), keep_tombstones=True)
    status = F.when(F.col("op").isNull(), "ABSENT").when(F.col("op") == DELETE, "DELETED").otherwise("FOUND")
    return wanted.join(state, "key", "left").select("key", status.alias("status"), "value")


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a delete."""
    return latest(log, keep_tombstones=True).where(F.col("op") == DELETE).select("key", "seq")


def range_scan(log: DataFrame, low, high) -> DataFrame:
    """Live keys in [low, high), bytewise order."""
    return latest(log.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))).select("key", "value").orderBy("key")


def answering_tier(log: DataFrame, tier: Column) -> DataFrame:
    """Which tier (memtable, or a run's number) answers a read of each key: (key, tier, status)."""
    top = log.groupBy("key").agg(F.max(F.struct("seq", "op", tier.alias("tier"))).alias("m"))
    return top.select("key", F.col("m.tier").alias("tier"), F.when(F.col("m.op") == DELETE, "DELETED").otherwise("FOUND").alias("status"))


def replay_stats(log: DataFrame) -> DataFrame:
    """One row: mutations, distinct keys, puts, deletes and the highest sequence number."""
    return log.agg(
        F.count("*").alias("entries"),
        F.countDistinct("key").alias("distinct_keys"),
        F.count_if(F.col("op") == PUT).alias("puts"),
        F.count_if(F.col("op") == DELETE).alias("deletes"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"),
    )


def dump(log: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Every entry as the inspection tools print it, in the order asked for."""
    shown = log.withColumns({"op_text": F.when(F.col("op") == DELETE, "DEL").otherwise("PUT"), "key_text": F.substring("key", 1, DUMP_KEY_WIDTH)})
    return shown.orderBy(*by).select(F.col("op_text").alias("op"), "seq", F.col("key_text").alias("key"), "value")


def compact(runs: DataFrame, bottom: bool) -> DataFrame:
    """Merges runs: newest mutation per key; at the bottom level tombstones go too."""
    return latest(runs, keep_tombstones=not bottom)
