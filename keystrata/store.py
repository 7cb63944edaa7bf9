"""A durable keyed store: Parquet log batches, sorted Parquet runs and a JSON manifest.

One writer assigns sequence numbers. Threads that put and delete at the same time share commits: whoever
holds the commit lock waits batch_timeout_ms at most for batch_size requests, writes them as one Parquet
batch and answers all of them. Reads are DataFrames over the manifest's files and the active log.

A batch is a folder of the log, and counts once its marker is there; the marker is written last, in one
step. A folder without one is an interrupted write: it is never read, and goes with vacuum(). The folder of
a stream's micro-batch bears the stream's name and the batch's number, so that the rows and the fact that
they were committed become visible together, and a replay after any crash is recognised.

What comes through the queue is in the driver already: its batches are written from there, without a job. While
the active log holds nothing else, the driver keeps its memtable, up to MEMTABLE_BYTES of keys and values, and a
flush writes the run from it. Logs with bulk loads, of a reopened store or beyond that limit are flushed by a job.
"""

from __future__ import annotations

import io
import json
import threading
import time
from collections import deque
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.model import DELETE, LOG_SCHEMA, PUT, InvalidKey, KeyNotFound, Options, Paths, checked_log
from keystrata.operators import latest as L
from keystrata.operators.layout import block_index, blocks_of_one
from keystrata.operators.manifest import FileMeta, Version
from keystrata.operators.ordered import numbered, ranged
from keystrata.sources.hadoop import Files
from keystrata.sources.scratch import release

MARKER = "_COMMITTED"
#: Keys and values that the driver keeps of the active log.
MEMTABLE_BYTES = 8 << 20
_ARROW = pa.schema([pa.field("seq", pa.int64(), False), pa.field("op", pa.int32(), False), pa.field("key", pa.binary(), False), pa.field("value", pa.binary())])


def _encoded(rows: Sequence[tuple]) -> bytes:
    """Rows (seq, op, key, value) as a Parquet file. All keys fit into the dictionary, which readers filter by."""
    out = io.BytesIO()
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW), out, use_dictionary=["key"], dictionary_pagesize_limit=2 * MEMTABLE_BYTES)
    return out.getvalue()


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class _Request:
    def __init__(self, op: int, key: bytes, value: bytes | None) -> None:
        self.row, self.done, self.error = (op, key, value), False, None


class Store:
    """Use Store.open(spark, path, **options)."""

    def __init__(self, spark: SparkSession, path: str, options: Options) -> None:
        self.spark, self.options, self.paths = spark, options, Paths(path.rstrip("/"))
        self.files = Files(spark, path)
        self._queue: deque[_Request] = deque()
        self._lock, self._waiting, self._closed = threading.RLock(), threading.Condition(), False
        self.version = Version()
        self._seq, self._keys = 0, set()
        self._streams: dict[str, int] = {}
        #: key -> (seq, op, key, value): the newest mutations of the active log, or None if the driver doesn't hold them all.
        self._memtable: dict[bytes, tuple] | None = {}
        self._memtable_bytes = 0

    @staticmethod
    def open(spark: SparkSession, path: str, **options) -> Store:
        """Opens or creates the store; an existing log is replayed. A damaged manifest raises."""
        s = Store(spark, path, Options(**options))
        for n in range(s.options.max_level + 1):
            s.files.mkdirs(f"{s.paths.base}/sstable/{n}")
        if s.files.exists(s.paths.manifest):
            s.version = Version.from_json(s.files.read_text(s.paths.manifest))
            state = s.wal().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            s._seq = max(state, s.version.extra.get("LastSeq", 0))
            # Enough keys to know whether the threshold is reached: a bulk load may hold any number.
            s._keys = {bytes(r[0]) for r in s.wal().select("key").distinct().limit(s.options.flush_threshold).collect()}
            s._streams = dict(s.version.extra.get("Streams", {}))
            batches = s._batches()
            if batches:
                s._memtable = None
            for name in batches:
                parts = name.split(".")
                if len(parts) == 3:
                    stream = bytes.fromhex(parts[1]).decode()
                    s._streams[stream] = max(s._streams.get(stream, -1), int(parts[2]))
        else:
            s.version = Version.empty(s.options.max_level + 1).with_wal(0)
            s._persist()
        return s

    # -- writes ---------------------------------------------------------------------------------

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self._submit([(PUT, _bytes(key), _bytes(value))])

    def delete(self, key: bytes | str) -> None:
        """Writes a tombstone, whether or not the key exists."""
        self._submit([(DELETE, _bytes(key), None)])

    def write(self, mutations: Iterable[tuple]) -> None:
        """(PUT, key, value) and (DELETE, key) tuples, in order."""
        self._submit([(m[0], _bytes(m[1]), _bytes(m[2]) if m[0] == PUT else None) for m in mutations])

    def _submit(self, rows: list[tuple[int, bytes, bytes | None]]) -> None:
        self._check_open()
        if any(not key for _, key, _ in rows):
            raise InvalidKey("empty key")
        mine = [_Request(*r) for r in rows]
        with self._waiting:
            self._queue.extend(mine)
            self._waiting.notify_all()
        while mine and not mine[-1].done:  # the queue is answered in order
            with self._lock:
                self._commit_some()
        for r in mine:
            if r.error:
                raise r.error

    def _take(self) -> list[_Request]:
        """Up to batch_size requests; waits batch_timeout_ms at most for the batch to fill up."""
        until = time.monotonic() + self.options.batch_timeout_ms / 1000
        with self._waiting:
            while 0 < len(self._queue) < self.options.batch_size and (left := until - time.monotonic()) > 0:
                self._waiting.wait(left)
            return [self._queue.popleft() for _ in range(min(len(self._queue), self.options.batch_size))]

    def _commit_some(self) -> None:
        batch = self._take()
        if not batch:
            return
        try:
            if len(self._keys) >= self.options.flush_threshold:
                self.flush()
            rows = [(self._seq + 1 + i, *r.row) for i, r in enumerate(batch)]
            name = f"batch={rows[0][0]:020d}"
            self.files.delete(self._batch_path(name))  # of an interrupted write
            self.files.write_bytes(f"{self._batch_path(name)}/part-0.parquet", _encoded(rows))
            self._mark(name, len(rows))
            self._seq = rows[-1][0]
            self._keys.update(r.row[1] for r in batch)
            self._remember(rows)
        except Exception as e:  # every writer of the batch gets the same answer
            self._memtable = None  # the log tells how far it came
            for r in batch:
                r.error = e
        for r in batch:
            r.done = True

    def _remember(self, rows: list[tuple]) -> None:
        if self._memtable is not None:
            self._memtable_bytes += sum(len(k) + len(v or b"") for _, _, k, v in rows)
            if self._memtable_bytes > MEMTABLE_BYTES:
                self._memtable = None
            else:
                self._memtable.update((r[2], r) for r in rows)

    def _batch_path(self, name: str) -> str:
        return f"{self.paths.wal(self.version.current_wal)}/{name}"

    def _write_batch(self, rows: DataFrame, name: str) -> None:
        """A batch is named by its first sequence number: a repeated write replaces itself."""
        rows.write.mode("overwrite").parquet(self._batch_path(name))

    def _mark(self, name: str, entries: int) -> None:
        """The commit point of a batch."""
        self.files.write_text(f"{self._batch_path(name)}/{MARKER}", json.dumps({"Entries": entries}))

    def _batches(self, number: int | None = None) -> list[str]:
        """Names of the committed batches of a log."""
        path = self.paths.wal(self.version.current_wal if number is None else number)
        return [name for name in self.files.names(path) if self.files.exists(f"{path}/{name}/{MARKER}")]

    def append(self, rows: DataFrame, order: str, stream: str | None = None, batch_id: int | None = None) -> None:
        """Bulk write of rows (op, key, value), numbered densely in the order of a column.

        The rows are dealt by range and stored once, numbered from the stored table, and written as one
        batch. With stream and batch_id a batch that was already committed is skipped.
        """
        self._check_open()
        with self._lock:
            if stream is not None and self._streams.get(stream, -1) >= batch_id:
                return
            if len(self._keys) >= self.options.flush_threshold:
                self.flush()
            self._memtable = None
            first = self._seq + 1
            name = f"batch={first:020d}" + ("" if stream is None else f".{stream.encode().hex()}.{batch_id}")
            stored = ranged(rows.select(F.col(order).alias("_order"), F.col("op").cast("int").alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), "_order")
            try:
                log = numbered(stored, "_n").select((F.col("_n") + self._seq).alias("seq"), "op", "key", "value")
                self._write_batch(checked_log(log), name)
                added = self.spark.read.schema(LOG_SCHEMA).parquet(self._batch_path(name))
                n, low, high, want = *added.agg(F.count("*"), F.min("seq"), F.max("seq")).first(), stored.count()
                if n != want or n and (low, high) != (first, first + n - 1):
                    raise RuntimeError(f"a bulk write gave {n} of {want} rows, numbered {low} to {high} instead of {first} to {first + want - 1}")
            finally:
                release(stored)
            self._mark(name, n)
            self._seq += n
            if len(self._keys) < self.options.flush_threshold:
                # A threshold of different keys is enough to know that it is reached.
                self._keys.update(bytes(r[0]) for r in added.select("key").distinct().limit(self.options.flush_threshold).collect())
            if stream is not None:
                self._streams[stream] = batch_id

    def flush(self) -> None:
        """Turns the active log into a sorted run at level 0 and starts the next log."""
        self._check_open()
        with self._lock:
            number = self.version.next_run
            meta = self._write_run(L.latest(self.wal(), keep_tombstones=True), 0, number) if self._memtable is None else self._write_memtable(number)
            if meta is None:
                return
            v = self.version.apply(add={0: [meta]}).with_wal(self.version.next_wal)
            self.version = Version(v.current_wal, v.levels, v.next_wal, v.next_run, {**v.extra, "LastSeq": self._seq, "Streams": dict(self._streams)})
            self._persist()
            self._keys, self._memtable, self._memtable_bytes = set(), {}, 0

    def _write_memtable(self, number: int) -> FileMeta | None:
        """The run at level 0 from what the driver holds."""
        if not self._memtable:
            return None
        keys, path = sorted(self._memtable), self.paths.run(0, number)
        self.files.delete(path)  # of an interrupted flush
        self.files.write_bytes(f"{path}/part-0.parquet", _encoded([self._memtable[k] for k in keys]))
        self.files.write_bytes(f"{path}/_SUCCESS", b"", sync=False)
        return FileMeta(number, keys[0], keys[-1], len(keys))

    def _write_run(self, state: DataFrame, level: int, number: int) -> FileMeta | None:
        path = self.paths.run(level, number)
        state.select(*LOG_SCHEMA.names).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.false_positive_rate)).parquet(path)
        lo, hi, n = self.spark.read.schema(LOG_SCHEMA).parquet(path).agg(F.min("key"), F.max("key"), F.count("*")).first()
        return FileMeta(number, bytes(lo), bytes(hi), n) if n else None

    def compact(self, level: int = 0) -> None:
        """Merges all runs of a level with those of the next one whose key ranges meet theirs. Where no deeper
        level holds anything, tombstones go: runs of the next level that are left out have none of the keys."""
        self._check_open()
        with self._lock:
            if level + 1 >= len(self.version.levels):
                raise IndexError("no level below")
            upper = self.version.levels[level]
            if not upper and level:
                return
            low, high = (min(f.smallest for f in upper), max(f.largest for f in upper)) if upper else (b"", None)
            lower = [f for f in self.version.levels[level + 1] if f.largest >= low and (high is None or f.smallest <= high)]
            if not upper and not lower:
                return
            deepest = all(not files for files in self.version.levels[level + 2 :])
            source = self._runs([*((level, f) for f in upper), *((level + 1, f) for f in lower)])
            meta = self._write_run(L.compact(source, bottom=deepest), level + 1, self.version.next_run)
            self.version = self.version.apply(add={level + 1: [meta] if meta else []}, delete={level: {f.number for f in upper}, level + 1: {f.number for f in lower}})
            self._persist()

    def maintain(self, max_runs: int = 4) -> list[int]:
        """Compacts every level with more than max_runs runs, from the top; returns the levels compacted."""
        done = []
        for level in range(len(self.version.levels) - 1):
            if len(self.version.levels[level]) > max_runs:
                self.compact(level)
                done.append(level)
        return done

    def metrics(self) -> dict[str, int]:
        """What an operator watches: waiting requests, keys and entries of the active log, runs and entries of
        each level, and the compaction debt: entries above the deepest populated level."""
        levels = self.version.levels
        entries = [sum(f.entries for f in files) for files in levels]
        deepest = max((n for n, files in enumerate(levels) if files), default=0)
        out = {"waiting": len(self._queue), "last_seq": self._seq, "log_entries": self.wal().count(), "compaction_debt": sum(entries[:deepest])}
        for n, files in enumerate(levels):
            out |= {f"l{n}_runs": len(files), f"l{n}_entries": entries[n]}
        return out

    def vacuum(self) -> list[str]:
        """Removes runs and logs that the manifest doesn't name, and interrupted batches; returns their paths."""
        with self._lock:
            log = self.paths.wal(self.version.current_wal)
            torn = [f"{log}/{x}" for x in sorted({*self.files.names(log)} - {*self._batches()})]
            keep = {self.paths.wal(self.version.current_wal)} | {self.paths.run(n, f.number) for n, files in enumerate(self.version.levels) for f in files}
            there = [f"{d}/{x}" for d in (f"{self.paths.base}/wal", *(f"{self.paths.base}/sstable/{n}" for n in range(len(self.version.levels)))) for x in self.files.names(d)]
            gone = [p for p in there if p not in keep] + torn
            for p in gone:
                self.files.delete(p)
            return gone

    def clear(self) -> None:
        """Removes everything and starts over with the same options."""
        with self._lock:
            self.files.delete(self.paths.base)
            self.__dict__.update(Store.open(self.spark, self.paths.base, **vars(self.options)).__dict__)

    def close(self) -> None:
        self._closed = True

    def _check_open(self) -> None:
        if self._closed:
            raise RuntimeError("the store is closed")

    def _persist(self) -> None:
        self.files.write_text(self.paths.manifest, self.version.to_json())

    # -- reads ----------------------------------------------------------------------------------

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], LOG_SCHEMA)

    def wal(self, number: int | None = None) -> DataFrame:
        """The committed batches of a log, in no particular order; sort by seq for append order."""
        path = self.paths.wal(self.version.current_wal if number is None else number)
        names = self._batches(number)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*(f"{path}/{x}" for x in names)) if names else self._empty()

    def memtable(self) -> DataFrame:
        return L.latest(self.wal(), keep_tombstones=True)

    def _run(self, level: int, f: FileMeta) -> DataFrame:
        return self._runs([(level, f)])

    def _runs(self, runs: list[tuple[int, FileMeta]]) -> DataFrame:
        """The mutations of (level, run) pairs, in one scan however many they are."""
        return self.spark.read.schema(LOG_SCHEMA).parquet(*(self.paths.run(n, f.number) for n, f in runs)) if runs else self._empty()

    def log(self, key: bytes | None = None) -> DataFrame:
        """Every mutation still stored. With a key, only runs whose key range holds it are opened."""
        with self._lock:
            runs = [(n, f) for n, files in enumerate(self.version.levels) for f in files if key is None or f.smallest <= key <= f.largest]
            return self.wal().unionByName(self._runs(runs))

    def get(self, key: bytes | str) -> bytes:
        """The live value; KeyNotFound if absent or deleted."""
        self._check_open()
        k = _bytes(key)
        row = L.point_get(self.log(k), bytearray(k)).first() if k else None
        if row is None:
            raise KeyNotFound(key)
        return bytes(row["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return L.multi_get(self.log(), keys.select(F.col("key").cast("binary").alias("key")))

    def scan(self, upto: int | None = None) -> DataFrame:
        """Live rows (key, value) in key order; upto reads a snapshot (complete back to the last compaction)."""
        return L.latest(self.log(), upto=upto).select("key", "value").orderBy("key")

    def inspect(self) -> DataFrame:
        """(tier, name, entries, smallest, largest, status, tier_entries): memtable and log (tier LM), then
        each run. A level without runs has a row with status empty; a run whose files are gone has status
        error, no entries, and doesn't count in its level's total."""
        head = [frame.agg(F.lit("LM").alias("tier"), F.lit(name).alias("name"), F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.lit("ok").alias("status")) for frame, name in ((self.memtable(), "memtable"), (self.wal(), f"wal/{self.version.current_wal}.log"))]
        rows = []
        for n, files in enumerate(self.version.levels):
            rows += [] if files else [(f"L{n}", None, None, None, None, "empty")]
            for f in files:
                ok = self.files.exists(f"{self.paths.run(n, f.number)}/_SUCCESS")
                rows.append((f"L{n}", f"{f.number}.sst", f.entries if ok else None, bytearray(f.smallest), bytearray(f.largest), "ok" if ok else "error"))
        runs = self.spark.createDataFrame(rows, "tier string, name string, entries long, smallest binary, largest binary, status string")
        every = reduce(DataFrame.unionByName, [*head, runs])
        totals = every.groupBy("tier").agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("tier_entries"))
        return every.join(totals, "tier")

    def blocks(self, level: int, number: int) -> DataFrame:
        """(block, block_offset, first_key, entries) of a run."""
        found = [f for f in self.version.levels[level] if f.number == number]
        if not found:
            raise FileNotFoundError(self.paths.run(level, number))
        rows = self._run(level, found[0]).select(F.lit(number).cast("long").alias("run"), "key", "value")
        return block_index(blocks_of_one(rows)).select("block", "block_offset", "first_key", "entries").orderBy("block")

    def range_scan(self, low: bytes | str, high: bytes | str, reverse: bool = False) -> DataFrame:
        """Live rows (key, value) with low <= key < high, in key order or against it."""
        a, b = _bytes(low), _bytes(high)
        runs = [(n, f) for n, files in enumerate(self.version.levels) for f in files if f.largest >= a and f.smallest < b]
        found = L.range_scan(self.wal().unionByName(self._runs(runs)), bytearray(a), bytearray(b))
        return found.orderBy(F.desc("key")) if reverse else found
