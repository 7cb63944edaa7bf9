"""Schemas, options, errors and the directory layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

PUT, DELETE = 0, 1

#: Canonical mutation log. Unsigned 32-bit sequence numbers do not fit INT, so seq is BIGINT.
#: A put has a non-null value (possibly empty); a delete has a null one.
LOG_SCHEMA = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("op", IntegerType(), False),
        StructField("key", BinaryType(), False),
        StructField("value", BinaryType(), True),
    ]
)
#: The same log with text keys and values.
TEXT_LOG_SCHEMA = StructType([StructField(f.name, StringType() if f.dataType == BinaryType() else f.dataType, f.nullable) for f in LOG_SCHEMA])

# Fixed values of the on-disk format.
ENTRY_HEADER_BYTES = 13
FOOTER_BYTES = 12
ENTRIES_PER_BLOCK = 64
DUMP_KEY_WIDTH = 20
HISTORY_LIMIT = 1000


class KeyNotFound(KeyError):
    """The key was never written, or its latest mutation is a delete."""


class InvalidKey(ValueError):
    """Keys must not be empty."""


class IncompleteEntry(ValueError):
    """An encoded entry ends before its announced length."""


@dataclass(frozen=True)
class Options:
    """Store settings.

    flush_threshold: distinct keys of the active log at which the next batch flushes it first.
    max_level: deepest level of a fresh store (levels are 0..max_level).
    batch_size, batch_timeout_ms: group commit.
    false_positive_rate: target of the Bloom filters.
    """

    flush_threshold: int = 256
    max_level: int = 3
    batch_size: int = 50
    batch_timeout_ms: int = 5
    false_positive_rate: float = 0.01

    def __post_init__(self) -> None:
        if self.flush_threshold < 1 or self.batch_size < 1 or self.max_level < 0:
            raise ValueError("flush_threshold and batch_size must be positive, max_level not negative")
        if not 0 < self.false_positive_rate < 1:
            raise ValueError("false_positive_rate must lie between 0 and 1")


@dataclass(frozen=True)
class Paths:
    """Where a store keeps its parts, under one base directory."""

    base: str

    def wal(self, number: int) -> str:
        return f"{self.base}/wal/{number}.log"

    def run(self, level: int, number: int) -> str:
        return f"{self.base}/sstable/{level}/{number}.sst"

    @property
    def manifest(self) -> str:
        return f"{self.base}/MANIFEST"

    @property
    def seed_index(self) -> str:
        return f"{self.base}/CLI_SEED_INDEX"


def checked_log(log: DataFrame) -> DataFrame:
    """The log with its invariants enforced: known op, non-empty key, value null exactly for deletes."""
    bad_op = ~F.col("op").isin(PUT, DELETE) | F.col("op").isNull()
    return log.select(
        "seq",
        F.when(bad_op, F.raise_error(F.lit("unknown mutation type"))).otherwise(F.col("op")).cast("int").alias("op"),
        F.when(F.coalesce(F.octet_length("key"), F.lit(0)) == 0, F.raise_error(F.lit("empty key"))).otherwise(F.col("key")).alias("key"),
        F.when(F.col("op") == PUT, F.coalesce("value", F.lit("").cast(log.schema["value"].dataType))).alias("value"),
    )
