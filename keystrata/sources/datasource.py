"""Spark data sources for binary logs (format "entrylog") and runs (format "sortedrun").

    register(spark)
    spark.read.format("entrylog").option("permissive", "true").load("dir/of/logs")
    df.write.format("sortedrun").mode("append").save("dir")

A path is a file or a directory of files; each file is a partition. Writers give one file per task.

lookup() and between() read runs through their filter and index: a list of keys costs one block for each key
that a run may hold, bounds skip the blocks outside. They are options of the source and not pushed-down
filters, because Spark 4.1 keeps the filters of one query in the DataFrame, and applies them to a later query
of the same DataFrame that has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from keystrata.sources import codec

SCHEMA = "file string, ord long, seq long, op int, key binary, value binary"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    tmp: str
    final: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind = options["path"], kind
        self.permissive = str(options.get("permissive", "false")).lower() == "true"
        self.keys = {bytes.fromhex(k) for k in options["keys"].split(",")} if "keys" in options else None
        self.low, self.high = (bytes.fromhex(options[x]) if x in options else None for x in ("low", "high"))

    def partitions(self) -> list[InputPartition]:
        files, p = open_fs(self.path)
        info = files.get_file_info(p)
        if info.type == fs.FileType.File:
            return [FilePart(p)]
        return [FilePart(i.path) for i in sorted(files.get_file_info(fs.FileSelector(p)), key=lambda i: i.path) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]

    def read(self, part: FilePart) -> Iterator[tuple]:
        files, _ = open_fs(self.path)
        if self.kind != "run":
            with files.open_input_stream(part.path, compression=None) as f:
                for n, e in enumerate(codec.decode_stream(f.read, permissive=self.permissive)):
                    yield part.path, n, *e
            return
        with files.open_input_file(part.path) as f:
            run = codec.Run(size=f.size(), read_at=lambda at, n: f.read_at(n, at))
            if self.keys is None:
                found = run.numbered(self.low, self.high)
            else:
                found = filter(None, map(run.find, sorted(self.keys)))
            for n, e in found:
                yield part.path, n, *e


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind, self.rate = options["path"], kind, float(options.get("false_positive_rate", 0.01))

    def write(self, rows: Iterator) -> Written:
        files, p = open_fs(self.path)
        files.create_dir(p, recursive=True)
        entries = ((r["seq"], r["op"], bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in rows)
        name = uuid.uuid4().hex
        tmp, final = f"{p}/.{name}.tmp", f"{p}/{name}.{'sst' if self.kind == 'run' else 'log'}"
        with files.open_output_stream(tmp, compression=None) as f:
            if self.kind == "run":
                for piece in codec.run_pieces(entries, self.rate):
                    f.write(piece)
            else:
                for e in entries:
                    f.write(codec.encode(*e))
        return Written(tmp, final)

    def commit(self, messages: list) -> None:
        files, _ = open_fs(self.path)
        for m in messages:
            if m:
                files.move(m.tmp, m.final)

    def abort(self, messages: list) -> None:
        files, _ = open_fs(self.path)
        for m in messages:
            if m:
                files.delete_file(m.tmp)


class EntryLog(DataSource):
    kind = "log"

    @classmethod
    def name(cls) -> str:
        return "entrylog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self.kind)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, self.kind)


class SortedRun(EntryLog):
    kind = "run"

    @classmethod
    def name(cls) -> str:
        return "sortedrun"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntryLog)
    spark.dataSource.register(SortedRun)


def lookup(spark: SparkSession, path: str, keys: list[bytes]) -> DataFrame:
    """The entries of some keys in runs: filter, index floor and one block for each key and run."""
    if not keys:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("sortedrun").option("keys", ",".join(bytes(k).hex() for k in keys)).load(path)


def between(spark: SparkSession, path: str, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """The entries with low <= key <= high in runs."""
    source = spark.read.format("sortedrun")
    for name, value in (("low", low), ("high", high)):
        source = source if value is None else source.option(name, bytes(value).hex())
    return source.load(path)
