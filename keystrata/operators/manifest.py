"""Versions of the run list as an edit log, and the JSON form of one version."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

FILE_STRUCT = StructType([StructField("FileNo", LongType()), StructField("SmallestKey", StringType()), StructField("LargestKey", StringType())])
VERSION_STRUCT = StructType(
    [StructField("CurrentWAL", LongType()), StructField("Levels", ArrayType(ArrayType(FILE_STRUCT))), StructField("NextWALNumber", LongType()), StructField("NextSSTableNumber", LongType())]
)


def live_files(edits: DataFrame, upto: int | None = None) -> DataFrame:
    """Files left after folding an edit log (edit_no, action 'add'|'delete', level, file_no, pos).

    Within one edit the deletes come first, so a file is gone only if a later edit deletes it.
    """
    src = edits if upto is None else edits.where(F.col("edit_no") <= upto)
    gone = src.where("action = 'delete'").groupBy("level", "file_no").agg(F.max("edit_no").alias("gone_at"))
    adds = src.where("action = 'add'").select("edit_no", "level", "file_no", "pos")
    return adds.join(gone, ["level", "file_no"], "left").where(F.col("gone_at").isNull() | (F.col("gone_at") <= F.col("edit_no"))).select("level", "file_no", "edit_no", "pos")


def next_numbers(edits: DataFrame) -> DataFrame:
    """The next run number after each prefix of the log; it never shrinks."""
    return edits.where("action = 'add'").agg((F.coalesce(F.max("file_no"), F.lit(-1)) + 1).cast("long").alias("next_run"))


def log_numbers(edits: DataFrame) -> DataFrame:
    """The active log and the next one's number after an edit log with rows of action 'wal': the last one counts."""
    return edits.where("action = 'wal'").agg(F.max_by("file_no", "edit_no").alias("current_wal"), (F.max_by("file_no", "edit_no") + 1).alias("next_wal"))


@dataclass(frozen=True)
class FileMeta:
    number: int
    smallest: bytes
    largest: bytes
    entries: int = 0

    @cached_property
    def json(self) -> dict:
        """The run in the manifest, which is written whole at each edit."""
        b64 = lambda b: base64.b64encode(b).decode()
        return {"FileNo": self.number, "SmallestKey": b64(self.smallest), "LargestKey": b64(self.largest), "Entries": self.entries}


@dataclass(frozen=True)
class Version:
    """An immutable snapshot of the run list; edits give new versions."""

    current_wal: int = 0
    levels: tuple[tuple[FileMeta, ...], ...] = ((),)
    next_wal: int = 0
    next_run: int = 0
    extra: dict = field(default_factory=dict)

    @staticmethod
    def empty(levels: int) -> Version:
        return Version(levels=((),) * levels)

    def with_wal(self, number: int) -> Version:
        return replace(self, current_wal=number, next_wal=number + 1)

    def apply(self, add: dict[int, list[FileMeta]] | None = None, delete: dict[int, set[int]] | None = None) -> Version:
        """Deletes by number first, then appends; the next run number never decreases."""
        add, delete = add or {}, delete or {}
        if any(not 0 <= n < len(self.levels) for n in [*add, *delete]):
            raise IndexError("no such level")
        levels = tuple(tuple(f for f in files if f.number not in delete.get(n, ())) + tuple(add.get(n, ())) for n, files in enumerate(self.levels))
        highest = max((f.number for files in add.values() for f in files), default=-1)
        return replace(self, levels=levels, next_run=max(self.next_run, highest + 1))

    def to_json(self) -> str:
        files = [[f.json for f in level] for level in self.levels]
        return json.dumps({"CurrentWAL": self.current_wal, "Levels": files, "NextWALNumber": self.next_wal, "NextSSTableNumber": self.next_run, **self.extra}, indent=2)

    @staticmethod
    def from_json(text: str) -> Version:
        d = json.loads(text)
        levels = tuple(tuple(FileMeta(f["FileNo"], base64.b64decode(f["SmallestKey"] or ""), base64.b64decode(f["LargestKey"] or ""), f.get("Entries", 0)) for f in level or ()) for level in d["Levels"])
        known = {"CurrentWAL", "Levels", "NextWALNumber", "NextSSTableNumber"}
        return Version(d["CurrentWAL"], levels, d["NextWALNumber"], d["NextSSTableNumber"], {k: v for k, v in d.items() if k not in known})

    def files(self, spark: SparkSession) -> DataFrame:
        """One row per run: (level, pos, file_no, smallest, largest, entries)."""
        schema = StructType([StructField("level", LongType()), StructField("pos", LongType()), StructField("file_no", LongType()), StructField("smallest", BinaryType()), StructField("largest", BinaryType()), StructField("entries", LongType())])
        return spark.createDataFrame([(n, p, f.number, bytearray(f.smallest), bytearray(f.largest), f.entries) for n, level in enumerate(self.levels) for p, f in enumerate(level)], schema)


def parse_manifest(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifest JSON documents as rows (level, pos, file_no, smallest, largest), keys decoded from base64."""
    v = texts.select(F.from_json(column, VERSION_STRUCT).alias("v"))
    level = v.select(F.col("v.CurrentWAL").alias("current_wal"), F.posexplode("v.Levels").alias("level", "files"))
    return level.select("current_wal", "level", F.posexplode("files").alias("pos", "f")).select("current_wal", "level", "pos", F.col("f.FileNo").alias("file_no"), F.unbase64("f.SmallestKey").alias("smallest"), F.unbase64("f.LargestKey").alias("largest"))
