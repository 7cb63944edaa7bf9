"""Queries that go through a store, a binary file or a stream: the write path and what reads it back.

Each builds what it needs in the shared folder from whole tables, and deletes it once its result is stored.
The event log is loaded in thirds by sequence number: two are flushed to runs, the last one stays in the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.seed import SEED_PAIRS, seed_rows
from keystrata.model import DELETE, PUT, IncompleteEntry
from keystrata.operators import manifest
from keystrata.sources import codec
from keystrata.sources.datasource import between, lookup, register
from keystrata.sources.hadoop import Files
from keystrata.sources.scratch import materialize, shared_dir
from keystrata.store import Store
from keystrata.streaming.ingest import ingest

LOW, HIGH = "click:2", "purchase:3"
RUN, RATE = 4096, 0.01


def events(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("value") < 2
    log = spark.read.parquet(f"{d}/events.parquet")
    return log.select((F.col("event_id") + 1).alias("ord"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.when(~gone, F.col("props")).alias("value"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def with_store(spark: SparkSession, load: Callable[[Store], None], read: Callable[[Store], DataFrame], **options) -> DataFrame:
    """The result of read on a new store after load, and after it was opened again."""
    path = _scratch(spark)
    store = Store.open(spark, path, **options)
    try:
        load(store)
        store.close()
        return materialize(read(Store.open(spark, path, **options)))
    finally:
        store.files.delete(path)


def thirds(spark: SparkSession, d: str) -> Callable[[Store], None]:
    def load(store: Store) -> None:
        log = events(spark, d)
        n = log.count()
        for i in range(3):
            if i:
                store.flush()
            store.append(log.where((F.col("ord") > n * i // 3) & (F.col("ord") <= n * (i + 1) // 3)), "ord")

    return load


THIRDS = """log AS (SELECT event_id + 1 AS seq, CASE WHEN value < 2 THEN 1 ELSE 0 END AS op, event_type || ':' || user_id AS key, CASE WHEN value < 2 THEN NULL ELSE props END AS value FROM events),
n AS (SELECT count(*) AS n FROM log), part AS (SELECT log.*, CASE WHEN seq <= n // 3 THEN 0 WHEN seq <= n * 2 // 3 THEN 1 ELSE 2 END AS third FROM log, n),
flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY third, key ORDER BY seq DESC) AS r FROM part) WHERE r = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM part WHERE third < 2) WHERE r = 1)"""


def store_scan(spark, d):
    """Bulk loads, flushes and a reopening; then the live rows."""
    return with_store(spark, thirds(spark, d), lambda s: _text(s.scan(), "key", "value"))


def store_snapshot(spark, d):
    """A snapshot within the part that is still in the log."""
    n = events(spark, d).count()
    return with_store(spark, thirds(spark, d), lambda s: _text(s.scan(upto=n * 5 // 6), "key", "value"))


def store_log(spark, d):
    """Every mutation that is still stored: the newest of each key in each run, and the whole log."""
    return with_store(spark, thirds(spark, d), lambda s: _text(s.log(), "key", "value").select("seq", "op", "key", "value"))


def store_memtable(spark, d):
    """The memtable as replayed from the log."""
    return with_store(spark, thirds(spark, d), lambda s: _text(s.memtable(), "key", "value").select("seq", "op", "key", "value"))


def store_multi_get(spark, d):
    probes = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("purchase:"), F.col("c_custkey").cast("string")).alias("key"))
    return with_store(spark, thirds(spark, d), lambda s: _text(s.multi_get(probes), "key", "value"))


def store_range_reverse(spark, d):
    return with_store(spark, thirds(spark, d), lambda s: _text(s.range_scan(LOW, HIGH, reverse=True), "key", "value"))


def store_compacted(spark, d):
    """Both runs merged into level 1, the deepest populated one, where tombstones go."""

    def load(store: Store) -> None:
        thirds(spark, d)(store)
        store.compact(0)
        store.vacuum()

    return with_store(spark, load, lambda s: _text(s._run(1, s.version.levels[1][0]), "key", "value").select("seq", "op", "key", "value"))


def store_inspect(spark, d):
    return with_store(spark, thirds(spark, d), lambda s: _text(s.inspect(), "smallest", "largest"))


def store_blocks(spark, d):
    return with_store(spark, thirds(spark, d), lambda s: _text(s.blocks(0, 1), "first_key"))


def store_manifest(spark, d):
    """The manifest as written to disk, parsed."""

    def read(store: Store) -> DataFrame:
        text = spark.read.text(store.paths.manifest, wholetext=True)
        return _text(manifest.parse_manifest(text), "smallest", "largest").select(F.col("level").cast("long").alias("level"), F.col("pos").cast("long").alias("pos"), "file_no", "smallest", "largest", "current_wal")

    return with_store(spark, thirds(spark, d), read)


def store_group_commit(spark, d):
    """Puts and deletes through the queue: batches of 50, with a threshold of 20 keys tested before each."""
    rows = [(r.k, r.v) for r in spark.read.parquet(f"{d}/supplier.parquet").orderBy("s_suppkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_name").alias("v")).toLocalIterator()]

    def load(store: Store) -> None:
        store.write([(DELETE, k) if n % 7 == 3 else (PUT, k, v) for n, (k, v) in enumerate(rows)])

    return with_store(spark, load, lambda s: _text(s.log(), "key", "value").select("seq", "op", "key", "value").withColumn("runs", F.lit(len(s.version.levels[0]))), flush_threshold=20, batch_size=50, batch_timeout_ms=0)


def store_seed(spark, d):
    """Generated pairs as the shell loads them, an index for each region."""
    indexes = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id"))
    return with_store(spark, lambda s: s.append(seed_rows(indexes), "ord"), lambda s: _text(s.wal(), "key", "value").select("seq", "key", "value"))


def stream_ingest(spark, d):
    """The event log as a stream, a file at a time, with all its micro-batches replayed once."""
    folder = _scratch(spark)
    events(spark, d).repartitionByRange(3, "ord").write.parquet(folder)

    def load(store: Store) -> None:
        stream = spark.readStream.schema(events(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        for n in range(2):  # a lost checkpoint: all batches come again
            ingest(stream, store, f"{folder}-checkpoint-{n}", order="ord").awaitTermination()

    files = Files(spark, folder)
    try:
        # All logs: the threshold is reached between the batches, and each flush begins another one.
        every = lambda s: reduce(DataFrame.unionByName, [s.wal(n) for n in range(s.version.current_wal + 1)])
        return with_store(spark, load, lambda s: every(s).agg(F.count("*").alias("mutations"), F.countDistinct("seq").alias("numbers"), F.max("seq").alias("last"), F.countDistinct("key").alias("keys")))
    finally:
        for p in (folder, f"{folder}-checkpoint-0", f"{folder}-checkpoint-1"):
            files.delete(p)


def _written(spark: SparkSession, rows: DataFrame, kind: str, read: Callable[[str], DataFrame]) -> DataFrame:
    register(spark)
    path = _scratch(spark)
    try:
        rows.write.format(kind).mode("append").save(path)
        return materialize(read(path))
    finally:
        Files(spark, path).delete(path)


def _binary(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Four runs of orders: a task writes each."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.lit(PUT).alias("op"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderpriority").alias("value"))
    return _binary(rows.repartitionByRange(4, "key").sortWithinPartitions("key"))


def entrylog_source(spark, d):
    """The event log in its binary form, written and read back."""
    log = events(spark, d).withColumnRenamed("ord", "seq")
    return _written(spark, _binary(log).sortWithinPartitions("seq"), "entrylog", lambda p: _text(spark.read.format("entrylog").load(p), "key", "value").select("seq", "op", "key", "value"))


def sortedrun_source(spark, d):
    """Runs with their filters and indexes, written and read back whole."""
    return _written(spark, _orders(spark, d), "sortedrun", lambda p: _text(spark.read.format("sortedrun").load(p), "key", "value").select("seq", "op", "key", "value"))


def sortedrun_lookup(spark, d):
    """Of the nations' numbers times 100 those that are orders, through filter, index and block."""
    keys = [f"{100 * r.n_nationkey:012d}".encode() for r in spark.read.parquet(f"{d}/nation.parquet").toLocalIterator()]
    return _written(spark, _orders(spark, d), "sortedrun", lambda p: _text(lookup(spark, p, keys), "key", "value").select("seq", "op", "key", "value"))


def sortedrun_between(spark, d):
    return _written(spark, _orders(spark, d), "sortedrun", lambda p: _text(between(spark, p, b"000000000100", b"000000000999"), "key", "value").select("seq", "op", "key", "value"))


def _order_runs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.floor(F.col("o_orderkey") / RUN).cast("long").alias("run"), F.col("o_orderkey").alias("seq"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderpriority").alias("value"))


def _encoded(rows: pd.DataFrame) -> codec.Run:
    """A run of bounded size in its binary form, opened again."""
    rows = rows.sort_values("key")
    return codec.Run(codec.encode_run(((s, PUT, k.encode(), v.encode()) for s, k, v in zip(rows["seq"], rows["key"], rows["value"], strict=True)), RATE))


def block_parse(spark, d):
    """Each block of encoded runs, decoded by itself: entries, first and last key, sum of sequence numbers."""

    def parse(rows: pd.DataFrame) -> pd.DataFrame:
        run = _encoded(rows)
        blocks = [run.block(n) for n in range(len(run.index))]
        return pd.DataFrame([(rows["run"].iloc[0], n, len(b), b[0][2].decode(), b[-1][2].decode(), sum(e[0] for e in b)) for n, b in enumerate(blocks)], columns=["run", "block", "entries", "first_key", "last_key", "seqs"])

    return _order_runs(spark, d).groupBy("run").applyInPandas(parse, "run long, block long, entries long, first_key string, last_key string, seqs long")


def run_get(spark, d):
    """Keys looked up in encoded runs through filter, index and block: every fifth number, order or not."""

    def get(rows: pd.DataFrame) -> pd.DataFrame:
        run, number = _encoded(rows), int(rows["run"].iloc[0])
        out = []
        for k in range(number * RUN, (number + 1) * RUN, 5):
            e = run.get(f"{k:012d}".encode())
            out.append((number, k, e is not None, e[3].decode() if e else None))
        return pd.DataFrame(out, columns=["run", "probe", "found", "value"])

    return _order_runs(spark, d).groupBy("run").applyInPandas(get, "run long, probe long, found boolean, value string")


def torn_logs(spark, d):
    """Logs of 1,024 mutations with the last five bytes missing: what a permissive reader gets, and whether a strict one raises."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        data = b"".join(codec.encode(s, o, k.encode(), v.encode() if isinstance(v, str) else None) for s, o, k, v in zip(rows["ord"], rows["op"], rows["key"], rows["value"], strict=True))[:-5]
        entries, raised = list(codec.decode(data, permissive=True)), False
        try:
            list(codec.decode(data))
        except IncompleteEntry:
            raised = True
        return pd.DataFrame([(rows["wal"].iloc[0], len(entries), max((e[0] for e in entries), default=0), raised)], columns=["wal", "entries", "max_seq", "raised"])

    logs = events(spark, d).withColumn("wal", F.floor((F.col("ord") - 1) / 1024).cast("long"))
    return logs.groupBy("wal").applyInPandas(read, "wal long, entries long, max_seq long, raised boolean")


def manifest_log_numbers(spark, d):
    """Each run of the event log switches to the next log."""
    runs = events(spark, d).select(F.floor((F.col("ord") - 1) / 1024).cast("long").alias("edit_no")).distinct()
    return manifest.log_numbers(runs.select("edit_no", F.lit("wal").alias("action"), (F.col("edit_no") + 1).alias("file_no")))


ORDERS = "SELECT o_orderkey AS seq, 0::INT AS op, lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderpriority AS value FROM orders"
RUN_SHAPE = "SELECT third, min(key) AS smallest, max(key) AS largest, count(*)::BIGINT AS entries FROM flushed WHERE third < 2 GROUP BY 1"
BLOCKED = """placed AS (SELECT key, (13 + strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes, row_number() OVER w AS rn, (sum(13 + strlen(key) + coalesce(strlen(value), 0)) OVER w - (13 + strlen(key) + coalesce(strlen(value), 0)))::BIGINT AS off
FROM flushed WHERE third = 1 WINDOW w AS (ORDER BY key))"""

#: name -> (query, DuckDB SQL)
STORED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_scan": (store_scan, f"WITH {THIRDS} SELECT key, value FROM top WHERE op = 0"),
    "store_snapshot": (store_snapshot, f"WITH {THIRDS}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq <= (SELECT n * 5 // 6 FROM n)) SELECT key, value FROM t WHERE r = 1 AND op = 0"),
    "store_log": (store_log, f"WITH {THIRDS} SELECT seq, op::INT AS op, key, value FROM part WHERE third = 2 UNION ALL SELECT seq, op::INT, key, value FROM flushed WHERE third < 2"),
    "store_memtable": (store_memtable, f"WITH {THIRDS} SELECT seq, op::INT AS op, key, value FROM flushed WHERE third = 2"),
    "store_multi_get": (
        store_multi_get,
        f"WITH {THIRDS}, probes AS (SELECT DISTINCT 'purchase:' || c_custkey AS key FROM customer) SELECT p.key, CASE WHEN t.op IS NULL THEN 'ABSENT' WHEN t.op = 1 THEN 'DELETED' ELSE 'FOUND' END AS status, t.value FROM probes p LEFT JOIN top t ON t.key = p.key",
    ),
    "store_range_reverse": (store_range_reverse, f"WITH {THIRDS} SELECT key, value FROM top WHERE op = 0 AND key >= '{LOW}' AND key < '{HIGH}' ORDER BY key DESC"),
    "store_compacted": (store_compacted, f"WITH {THIRDS} SELECT seq, op::INT AS op, key, value FROM old WHERE op = 0"),
    "store_inspect": (
        store_inspect,
        f"""WITH {THIRDS}, run AS ({RUN_SHAPE}), x AS (
SELECT 'L0' AS tier, third || '.sst' AS name, entries, smallest, largest, 'ok' AS status FROM run
UNION ALL SELECT 'LM', 'memtable', count(*)::BIGINT, min(key), max(key), 'ok' FROM flushed WHERE third = 2
UNION ALL SELECT 'LM', 'wal/2.log', count(*)::BIGINT, min(key), max(key), 'ok' FROM part WHERE third = 2
UNION ALL SELECT 'L' || i, NULL, NULL, NULL, NULL, 'empty' FROM (SELECT unnest([1, 2, 3]) AS i))
SELECT *, coalesce(sum(entries) OVER (PARTITION BY tier), 0)::BIGINT AS tier_entries FROM x""",
    ),
    "store_blocks": (store_blocks, f"WITH {THIRDS}, {BLOCKED} SELECT ((rn - 1) // 64)::BIGINT AS block, min(off)::BIGINT AS block_offset, min(key) AS first_key, count(*)::BIGINT AS entries FROM placed GROUP BY 1"),
    "store_manifest": (store_manifest, f"WITH {THIRDS}, run AS ({RUN_SHAPE}) SELECT 0::BIGINT AS level, third::BIGINT AS pos, third::BIGINT AS file_no, smallest, largest, 2::BIGINT AS current_wal FROM run"),
    "store_group_commit": (
        store_group_commit,
        "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS seq, 's' || s_suppkey AS key, s_name AS value FROM supplier) SELECT seq, CASE WHEN (seq - 1) % 7 = 3 THEN 1 ELSE 0 END::INT AS op, key, CASE WHEN (seq - 1) % 7 = 3 THEN NULL ELSE value END AS value, ((SELECT count(*) FROM s) - 1)::INT // 50 AS runs FROM s",
    ),
    "store_seed": (
        store_seed,
        "SELECT row_number() OVER (ORDER BY lpad(i::VARCHAR, 12, '0') || k) AS seq, k || i AS key, v || i AS value FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SEED_PAIRS) + ") AS p(k, v), (SELECT r_regionkey AS i FROM region)",
    ),
    "stream_ingest": (stream_ingest, f"WITH {THIRDS} SELECT count(*)::BIGINT AS mutations, count(*)::BIGINT AS numbers, count(*)::BIGINT AS last, count(DISTINCT key)::BIGINT AS keys FROM log"),
    "block_parse": (
        block_parse,
        f"SELECT run, ((rn - 1) // 64)::BIGINT AS block, count(*)::BIGINT AS entries, min(key) AS first_key, max(key) AS last_key, sum(seq)::BIGINT AS seqs FROM (SELECT (seq // {RUN})::BIGINT AS run, seq, key, row_number() OVER (PARTITION BY seq // {RUN} ORDER BY key) AS rn FROM ({ORDERS})) GROUP BY 1, 2",
    ),
    "run_get": (
        run_get,
        f"WITH o AS ({ORDERS}), r AS (SELECT DISTINCT (seq // {RUN})::BIGINT AS run FROM o), p AS (SELECT run, unnest(range(run * {RUN}, (run + 1) * {RUN}, 5))::BIGINT AS probe FROM r) SELECT run, probe, o.key IS NOT NULL AS found, o.value FROM p LEFT JOIN o ON o.seq = p.probe",
    ),
    "torn_logs": (torn_logs, f"WITH {THIRDS}, l AS (SELECT ((seq - 1) // 1024)::BIGINT AS wal, seq, row_number() OVER (PARTITION BY (seq - 1) // 1024 ORDER BY seq DESC) AS r FROM log) SELECT wal, (count(*) - 1)::BIGINT AS entries, coalesce(max(seq) FILTER (r > 1), 0)::BIGINT AS max_seq, true AS raised FROM l GROUP BY 1"),
    "manifest_log_numbers": (manifest_log_numbers, f"WITH {THIRDS} SELECT ((max(seq) - 1) // 1024 + 1)::BIGINT AS current_wal, ((max(seq) - 1) // 1024 + 2)::BIGINT AS next_wal FROM log"),
    "entrylog_source": (entrylog_source, f"WITH {THIRDS} SELECT seq, op::INT AS op, key, value FROM log"),
    "sortedrun_source": (sortedrun_source, ORDERS),
    "sortedrun_lookup": (sortedrun_lookup, f"{ORDERS} WHERE o_orderkey IN (SELECT 100 * n_nationkey FROM nation)"),
    "sortedrun_between": (sortedrun_between, f"{ORDERS} WHERE o_orderkey BETWEEN 100 AND 999"),
}
