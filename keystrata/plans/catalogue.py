"""The query catalogue: each operator on the test tables, with its DuckDB equivalent.

The events table is the mutation log: seq = event_id + 1, key = event_type:user_id, a value under 2 is a
delete. The orders table is a bulk load of sorted runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import bloom, seed, text
from keystrata.operators import latest as L
from keystrata.operators import layout, manifest, ordered, segments
from keystrata.plans.stored import STORED

RUN = 1024
BATCH = 50
THRESHOLD = 50
RATE = 0.01
SNAPSHOT = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("value") < 2
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.when(gone, 1).otherwise(0).alias("op"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.when(~gone, F.col("props")).alias("value")
    )


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 4096).cast("long").alias("run"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderpriority").alias("value"))


def keys_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("key").distinct()


LOG = "log AS (SELECT event_id + 1 AS seq, CASE WHEN value < 2 THEN 1 ELSE 0 END AS op, event_type || ':' || user_id AS key, CASE WHEN value < 2 THEN NULL ELSE props END AS value FROM events)"
TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"
RUNS = "runs AS (SELECT (o_orderkey // 4096)::BIGINT AS run, lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderpriority AS value FROM orders)"
BLOCKS = f"""{RUNS}, sized AS (SELECT *, (strlen(key) + strlen(value) + 13)::BIGINT AS bytes FROM runs),
placed AS (SELECT *, row_number() OVER w AS rn, (sum(bytes) OVER w - bytes)::BIGINT AS "offset", ((row_number() OVER w - 1) // 64)::BIGINT AS block FROM sized WINDOW w AS (PARTITION BY run ORDER BY key))"""
INDEX = f"{BLOCKS}, idx AS (SELECT run, block, min(key) AS first_key, min(\"offset\")::BIGINT AS block_offset, count(*)::BIGINT AS entries FROM placed GROUP BY 1, 2)"
EVENT_RUNS = f"{LOG}, meta AS (SELECT ((seq - 1) // {RUN})::BIGINT AS run, min(key) AS smallest, max(key) AS largest, count(*)::BIGINT AS entries FROM log GROUP BY 1)"
FNV = "list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: ((h - h % 256) + xor(h % 256, b)) * 1099511628211 % 18446744073709551616, 14695981039346656037::HUGEINT)"
HASHED = f"h AS (SELECT key, h1, CASE WHEN h2 = 0 THEN 1 ELSE h2 END AS h2 FROM (SELECT key, h1, ((h1 - h1 % 256) + xor(h1 % 256, 1::HUGEINT)) * 1099511628211 % 18446744073709551616 AS h2 FROM (SELECT key, {FNV} AS h1 FROM keys)))"


def _bits(n: str) -> str:
    return f"ceil(-{n} * ln({RATE}) / (ln(2) * ln(2)))::BIGINT"


def _hashes(n: str) -> str:
    return f"greatest(ceil({_bits(n)} / {n} * ln(2))::BIGINT, 1)"


BITS = f"""{LOG}, keys AS (SELECT DISTINCT key FROM log), n AS (SELECT count(*) AS n FROM keys), p AS (SELECT {_bits("n")} AS m, {_hashes("n")} AS k FROM n), {HASHED},
bits AS (SELECT DISTINCT (((h1 + i * h2) % 18446744073709551616) % m)::BIGINT AS pos FROM h, p, LATERAL (SELECT unnest(range(0, k)) AS i))"""


def _filter(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    keys = keys_of_events(spark, sf_dir)
    m, k = bloom.params(keys.count(), RATE)
    return bloom.bit_set(keys, m, k), m, k


def _absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("absent:"), F.col("o_orderkey").cast("string")).alias("key"))


ABSENT = "absent AS (SELECT DISTINCT 'absent:' || o_orderkey AS key FROM orders)"


def current_state(spark, d):
    return L.latest(event_log(spark, d)).select("key", "seq", "value")


def point_get(spark, d):
    return L.point_get(event_log(spark, d), "click:7")


def multi_get(spark, d):
    probes = table(spark, d, "customer").select(F.concat(F.lit("purchase:"), F.col("c_custkey").cast("string")).alias("key"))
    return L.multi_get(event_log(spark, d), probes)


def get_source(spark, d):
    return L.answering_tier(event_log(spark, d), segments.run_number(F.col("seq"), RUN))


def memtable_dump(spark, d):
    log = event_log(spark, d)
    active = log.join(F.broadcast(log.agg(F.max(segments.run_number(F.col("seq"), RUN)).alias("last"))), segments.run_number(F.col("seq"), RUN) == F.col("last")).drop("last")
    return L.dump(L.latest(active, keep_tombstones=True), by=["key"])


def wal_dump(spark, d):
    return L.dump(event_log(spark, d))


def tombstones(spark, d):
    return L.tombstones(event_log(spark, d))


def wal_replay_stats(spark, d):
    return L.replay_stats(event_log(spark, d))


def entry_sizes(spark, d):
    return event_log(spark, d).select("seq", layout.entry_bytes().alias("bytes"))


def wal_offsets(spark, d):
    log = event_log(spark, d).withColumn("wal", segments.run_number(F.col("seq"), RUN))
    return layout.offsets(log, "seq", by="wal").select("wal", "seq", "bytes", "offset")


def group_commit_batches(spark, d):
    return segments.group_commit(event_log(spark, d), BATCH)


def local_seq(spark, d):
    return segments.local_seq(event_log(spark, d), segments.run_number(F.col("seq"), RUN))


def flush_segments(spark, d):
    log = event_log(spark, d).select("seq", "key")
    return segments.flush_segments(log, THRESHOLD).groupBy("segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("key").alias("keys"))


def flush_segments_in_batches(spark, d):
    """The threshold is tested once per group commit."""
    log = event_log(spark, d).select("seq", "key")
    return segments.flush_segments(log, THRESHOLD, batch_size=BATCH).groupBy("segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("key").alias("keys"))


def bulk_append_numbers(spark, d):
    """Sequence numbers of a bulk load, in the order of a text column that is not the stored one."""
    rows = table(spark, d, "lineitem").select(F.concat_ws("/", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber", F.format_string("%.2f", "l_extendedprice"), F.date_format("l_shipdate", "yyyyMMdd")).alias("ord"))
    return ordered.numbered(ordered.ranged(rows.distinct(), "ord"), "seq").select("seq", "ord")


def run_metadata(spark, d):
    return layout.run_metadata(order_runs(spark, d)).select("run", "smallest", "largest", "entries", F.col("data_bytes").cast("long").alias("data_bytes"))


def block_assignment(spark, d):
    return layout.blocks(order_runs(spark, d)).select("run", "block", "key", "offset")


def block_index(spark, d):
    return layout.block_index(layout.blocks(order_runs(spark, d)))


def index_floor_lookup(spark, d):
    probes = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 4096).cast("long").alias("run"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("key")).distinct()
    return layout.floor_lookup(layout.block_index(layout.blocks(order_runs(spark, d))), probes)


def run_footer(spark, d):
    return layout.footers(order_runs(spark, d), RATE)


def bloom_params(spark, d):
    sizes = layout.run_metadata(order_runs(spark, d)).select("run", F.col("entries").alias("n"))
    return sizes.select("run", "n", bloom.optimal_bits(F.col("n"), RATE).alias("m"), bloom.optimal_hashes(F.col("n"), RATE).alias("k"))


def bloom_hash(spark, d):
    h = keys_of_events(spark, d).withColumn("h", bloom.fnv1a(F.col("key")))
    return h.select("key", bloom.as_decimal(F.col("h")).cast("string").alias("h1"), bloom.as_decimal(bloom.second_hash(F.col("h"))).cast("string").alias("h2"))


def bloom_bits(spark, d):
    return _filter(spark, d)[0]


def bloom_probe(spark, d):
    bits, m, k = _filter(spark, d)
    return bloom.may_contain(bits, keys_of_events(spark, d).unionByName(_absent(spark, d)), m, k)


def bloom_fpr(spark, d):
    bits, m, k = _filter(spark, d)
    return bloom.may_contain(bits, _absent(spark, d), m, k).agg(F.count("*").alias("probes"), F.count_if("maybe").alias("false_positives"))


def bitmap_ops(spark, d):
    """Adds every user id, removes those whose latest event is a delete, and gives the bytes."""
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("value") < 2, 1).otherwise(0).alias("op"), F.lit("").alias("value"))
    return bloom.bitmap_bytes(L.latest(log).select(F.col("key").alias("pos")), 1 << 31)


def bitmap_contains(spark, d):
    have = table(spark, d, "events").select(F.col("user_id").alias("pos")).distinct()
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"))
    return asked.join(have.withColumn("_in", F.lit(True)), "pos", "left").select("pos", F.coalesce("_in", F.lit(False)).alias("contained"))


def _edits(spark, d):
    """Each run of the log is added at level 0 by its own edit; every fourth edit merges the three before it into level 1."""
    runs = event_log(spark, d).select(segments.run_number(F.col("seq"), RUN // 4).alias("run")).distinct()
    add = runs.where("run % 4 <> 3").select(F.col("run").alias("edit_no"), F.lit("add").alias("action"), F.lit(0).alias("level"), F.col("run").alias("file_no"), F.lit(0).alias("pos"))
    merged = runs.where("run % 4 = 3").select(F.col("run").alias("edit_no"), F.lit("add").alias("action"), F.lit(1).alias("level"), F.col("run").alias("file_no"), F.lit(0).alias("pos"))
    gone = runs.where("run % 4 = 3").select(F.col("run").alias("edit_no"), F.lit("delete").alias("action"), F.lit(0).alias("level"), F.explode(F.sequence(F.col("run") - 3, F.col("run") - 1)).alias("file_no"), F.lit(0).alias("pos"))
    return add.unionByName(merged).unionByName(gone)


EDITS = f"""{LOG}, r AS (SELECT DISTINCT ((seq - 1) // {RUN // 4})::BIGINT AS run FROM log), edits AS (
SELECT run AS edit_no, 'add' AS action, CASE WHEN run % 4 = 3 THEN 1 ELSE 0 END AS level, run AS file_no FROM r
UNION ALL SELECT run, 'delete', 0, run - i FROM r, LATERAL (SELECT unnest([1, 2, 3]) AS i) WHERE run % 4 = 3)"""


def manifest_live_files(spark, d):
    return manifest.live_files(_edits(spark, d)).select("level", "file_no", "edit_no")


def manifest_next_numbers(spark, d):
    return manifest.next_numbers(_edits(spark, d))


def inspect_levels(spark, d):
    """Entries and files per level, with the total, for runs at level 0 and the merged level below."""
    runs = layout.run_metadata(event_log(spark, d).withColumn("run", segments.run_number(F.col("seq"), RUN)))
    levels = runs.withColumn("level", F.when(F.col("run") % 2 == 0, 0).otherwise(1))
    return levels.rollup("level").agg(F.count("*").alias("files"), F.sum("entries").alias("entries")).select(F.coalesce(F.col("level").cast("string"), F.lit("total")).alias("level"), "files", "entries")


def seed_pairs(spark, d):
    """The generated pairs of the shell's seed command, an index for each nation."""
    count = table(spark, d, "nation").agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("id"))
    return seed.seed_rows(count).select("key", "value")


def history_dedup(spark, d):
    return segments.keep_last(table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("cmd")), 1000)


def compaction_merge(spark, d):
    return L.compact(event_log(spark, d), bottom=False)


def compaction_bottom(spark, d):
    return L.compact(event_log(spark, d), bottom=True)


def snapshot_read(spark, d):
    return L.latest(event_log(spark, d), upto=SNAPSHOT).select("key", "seq", "value")


def range_scan(spark, d):
    return L.range_scan(event_log(spark, d), "click:2", "purchase:3")


def _meta(spark, d):
    return layout.run_metadata(event_log(spark, d).withColumn("run", segments.run_number(F.col("seq"), RUN)))


def run_overlap(spark, d):
    return layout.run_overlap(_meta(spark, d))


def read_amplification(spark, d):
    return layout.read_amplification(_meta(spark, d), keys_of_events(spark, d))


def encoded_entries(spark, d):
    e = text.encode_entry(F.col("op"), F.col("seq"), F.col("key"), F.col("value"))
    return event_log(spark, d).select("seq", F.hex(e).alias("entry"))


def duration_text(spark, d):
    return table(spark, d, "events").select("event_id", text.duration_text(F.col("event_id") * F.lit(262144)).alias("took"))


def _le32(expr: str) -> str:
    h = f"lpad(printf('%X', ({expr})::BIGINT), 8, '0')"
    return f"substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2)"


#: name -> (query, DuckDB SQL)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "current_state": (current_state, f"WITH {LOG}, {TOP} SELECT key, seq, value FROM top WHERE op = 0"),
    "point_get": (point_get, f"WITH {LOG}, {TOP} SELECT key, value FROM top WHERE op = 0 AND key = 'click:7'"),
    "multi_get": (
        multi_get,
        f"WITH {LOG}, {TOP}, probes AS (SELECT DISTINCT 'purchase:' || c_custkey AS key FROM customer) SELECT p.key, CASE WHEN t.op IS NULL THEN 'ABSENT' WHEN t.op = 1 THEN 'DELETED' ELSE 'FOUND' END AS status, t.value FROM probes p LEFT JOIN top t ON t.key = p.key",
    ),
    "get_source": (get_source, f"WITH {LOG}, {TOP} SELECT key, ((seq - 1) // {RUN})::BIGINT AS tier, CASE WHEN op = 1 THEN 'DELETED' ELSE 'FOUND' END AS status FROM top"),
    "memtable_dump": (
        memtable_dump,
        f"WITH {LOG}, act AS (SELECT * FROM log WHERE (seq - 1) // {RUN} = (SELECT max((seq - 1) // {RUN}) FROM log)), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM act) SELECT CASE WHEN op = 1 THEN 'DEL' ELSE 'PUT' END AS op, seq, substr(key, 1, 20) AS key, value FROM t WHERE r = 1 ORDER BY t.key",
    ),
    "wal_dump": (wal_dump, f"WITH {LOG} SELECT CASE WHEN op = 1 THEN 'DEL' ELSE 'PUT' END AS op, seq, substr(key, 1, 20) AS key, value FROM log ORDER BY seq"),
    "tombstones": (tombstones, f"WITH {LOG}, {TOP} SELECT key, seq FROM top WHERE op = 1"),
    "wal_replay_stats": (wal_replay_stats, f"WITH {LOG} SELECT count(*)::BIGINT AS entries, count(DISTINCT key)::BIGINT AS distinct_keys, count(*) FILTER (op = 0)::BIGINT AS puts, count(*) FILTER (op = 1)::BIGINT AS deletes, coalesce(max(seq), 0)::BIGINT AS max_seq FROM log"),
    "entry_sizes": (entry_sizes, f"WITH {LOG} SELECT seq, (13 + strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes FROM log"),
    "wal_offsets": (
        wal_offsets,
        f'WITH {LOG}, s AS (SELECT ((seq - 1) // {RUN})::BIGINT AS wal, seq, (13 + strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes FROM log) SELECT wal, seq, bytes, (sum(bytes) OVER (PARTITION BY wal ORDER BY seq) - bytes)::BIGINT AS "offset" FROM s',
    ),
    "group_commit_batches": (group_commit_batches, f"WITH {LOG} SELECT ((seq - 1) // {BATCH})::BIGINT AS batch, count(*)::BIGINT AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1"),
    "local_seq": (local_seq, f"WITH {LOG} SELECT ((seq - 1) // {RUN})::BIGINT AS run, row_number() OVER (PARTITION BY (seq - 1) // {RUN} ORDER BY seq) AS local_seq, seq, key FROM log"),
    "flush_segments": (
        flush_segments,
        f"""WITH RECURSIVE {LOG}, o AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, key FROM log), walk(n, seq, key, keys, segment) AS (
SELECT n, seq, key, [key], 0::BIGINT FROM o WHERE n = 1
UNION ALL SELECT o.n, o.seq, o.key, CASE WHEN len(w.keys) >= {THRESHOLD} THEN [o.key] WHEN list_contains(w.keys, o.key) THEN w.keys ELSE list_append(w.keys, o.key) END, w.segment + CASE WHEN len(w.keys) >= {THRESHOLD} THEN 1 ELSE 0 END
FROM walk w JOIN o ON o.n = w.n + 1)
SELECT segment, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT key)::BIGINT AS keys FROM walk GROUP BY 1""",
    ),
    "flush_segments_in_batches": (
        flush_segments_in_batches,
        f"""WITH RECURSIVE {LOG}, o AS (SELECT (seq - 1) // {BATCH} AS n, list(DISTINCT key) AS ks, min(seq) AS lo, max(seq) AS hi FROM log GROUP BY 1), walk(n, lo, hi, keys, segment) AS (
SELECT n, lo, hi, ks, 0::BIGINT FROM o WHERE n = 0
UNION ALL SELECT o.n, o.lo, o.hi, CASE WHEN len(w.keys) >= {THRESHOLD} THEN o.ks ELSE list_distinct(list_concat(w.keys, o.ks)) END, w.segment + CASE WHEN len(w.keys) >= {THRESHOLD} THEN 1 ELSE 0 END
FROM walk w JOIN o ON o.n = w.n + 1)
SELECT segment, min(lo) AS first_seq, max(hi) AS last_seq, max(len(keys))::BIGINT AS keys FROM walk GROUP BY 1""",
    ),
    "bulk_append_numbers": (
        bulk_append_numbers,
        "SELECT row_number() OVER (ORDER BY ord) AS seq, ord FROM (SELECT DISTINCT concat_ws('/', lpad(l_partkey::VARCHAR, 9, '0'), lpad(l_orderkey::VARCHAR, 9, '0'), l_linenumber, printf('%.2f', l_extendedprice), strftime(l_shipdate, '%Y%m%d')) AS ord FROM lineitem)",
    ),
    "run_metadata": (run_metadata, f"WITH {RUNS} SELECT run, min(key) AS smallest, max(key) AS largest, count(*)::BIGINT AS entries, sum(strlen(key) + strlen(value) + 13)::BIGINT AS data_bytes FROM runs GROUP BY 1"),
    "block_assignment": (block_assignment, f'WITH {BLOCKS} SELECT run, block, key, "offset" FROM placed'),
    "block_index": (block_index, f"WITH {INDEX} SELECT run, block, first_key, block_offset, entries FROM idx"),
    "index_floor_lookup": (
        index_floor_lookup,
        f"WITH {INDEX}, probes AS (SELECT DISTINCT (l_orderkey // 4096)::BIGINT AS run, lpad(l_orderkey::VARCHAR, 12, '0') AS key FROM lineitem) SELECT p.run, p.key, i.block, i.block_offset FROM probes p ASOF LEFT JOIN idx i ON p.run = i.run AND p.key >= i.first_key",
    ),
    "run_footer": (
        run_footer,
        f"""WITH {INDEX}, x AS (SELECT run, count(*)::BIGINT AS blocks, (4 + sum(8 + strlen(first_key)))::BIGINT AS index_bytes, sum(entries)::BIGINT AS entries FROM idx GROUP BY 1),
f AS (SELECT run, sum(bytes)::BIGINT AS filter_offset FROM placed GROUP BY 1), g AS (SELECT x.run, x.entries, x.blocks, f.filter_offset, (f.filter_offset + 8 + ceil({_bits("x.entries")} / 8))::BIGINT AS index_offset, index_bytes FROM x JOIN f ON x.run = f.run)
SELECT run, entries, blocks, filter_offset, index_offset, index_offset + index_bytes AS footer_offset, index_offset + index_bytes + 12 AS file_bytes FROM g""",
    ),
    "bloom_params": (bloom_params, f"WITH {RUNS}, s AS (SELECT run, count(*)::BIGINT AS n FROM runs GROUP BY 1) SELECT run, n, {_bits('n')} AS m, {_hashes('n')} AS k FROM s"),
    "bloom_hash": (bloom_hash, f"WITH {LOG}, keys AS (SELECT DISTINCT key FROM log), {HASHED} SELECT key, h1::VARCHAR AS h1, h2::VARCHAR AS h2 FROM h"),
    "bloom_bits": (bloom_bits, f"WITH {BITS} SELECT pos FROM bits"),
    "bloom_probe": (
        bloom_probe,
        f"WITH {BITS}, {ABSENT}, asked AS (SELECT key FROM keys UNION SELECT key FROM absent), {HASHED.replace('h AS', 'ha AS', 1).replace('FROM keys', 'FROM asked')} SELECT key, bool_and(pos IS NOT NULL) AS maybe FROM (SELECT key, b.pos FROM (SELECT key, (((h1 + i * h2) % 18446744073709551616) % m)::BIGINT AS q FROM ha, p, LATERAL (SELECT unnest(range(0, k)) AS i)) LEFT JOIN bits b ON b.pos = q) GROUP BY 1",
    ),
    "bloom_fpr": (
        bloom_fpr,
        f"WITH {BITS}, {ABSENT}, {HASHED.replace('h AS', 'ha AS', 1).replace('FROM keys', 'FROM absent')}, t AS (SELECT key, bool_and(pos IS NOT NULL) AS maybe FROM (SELECT key, b.pos FROM (SELECT key, (((h1 + i * h2) % 18446744073709551616) % m)::BIGINT AS q FROM ha, p, LATERAL (SELECT unnest(range(0, k)) AS i)) LEFT JOIN bits b ON b.pos = q) GROUP BY 1) SELECT count(*)::BIGINT AS probes, count(*) FILTER (maybe)::BIGINT AS false_positives FROM t",
    ),
    "bitmap_ops": (
        bitmap_ops,
        "WITH t AS (SELECT user_id AS pos, CASE WHEN value < 2 THEN 1 ELSE 0 END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT (pos // 8)::BIGINT AS byte_no, bit_or((1 << (pos % 8)::INT)::BIGINT)::BIGINT AS byte FROM t WHERE r = 1 AND op = 0 GROUP BY 1",
    ),
    "bitmap_contains": (bitmap_contains, "SELECT c_custkey AS pos, c_custkey IN (SELECT user_id FROM events) AS contained FROM customer"),
    "manifest_live_files": (manifest_live_files, f"WITH {EDITS} SELECT level::INT AS level, file_no, edit_no FROM edits a WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM edits g WHERE g.action = 'delete' AND g.level = a.level AND g.file_no = a.file_no AND g.edit_no > a.edit_no)"),
    "manifest_next_numbers": (manifest_next_numbers, f"WITH {EDITS} SELECT (max(file_no) + 1)::BIGINT AS next_run FROM edits WHERE action = 'add'"),
    "inspect_levels": (inspect_levels, f"WITH {EVENT_RUNS} SELECT coalesce(level::VARCHAR, 'total') AS level, count(*)::BIGINT AS files, sum(entries)::BIGINT AS entries FROM (SELECT CASE WHEN run % 2 = 0 THEN 0 ELSE 1 END AS level, entries FROM meta) GROUP BY ROLLUP (level)"),
    "seed_pairs": (seed_pairs, "SELECT k || i AS key, v || i AS value FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in seed.SEED_PAIRS) + ") AS p(k, v), (SELECT unnest(range(0, (SELECT count(*) FROM nation))) AS i)"),
    "history_dedup": (history_dedup, "SELECT ord, cmd FROM (SELECT event_id AS ord, event_type AS cmd, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> cmd ORDER BY ord DESC LIMIT 1000"),
    "compaction_merge": (compaction_merge, f"WITH {LOG}, {TOP} SELECT key, seq, op, value FROM top"),
    "compaction_bottom": (compaction_bottom, f"WITH {LOG}, {TOP} SELECT key, seq, op, value FROM top WHERE op = 0"),
    "snapshot_read": (snapshot_read, f"WITH {LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq <= {SNAPSHOT}) SELECT key, seq, value FROM t WHERE r = 1 AND op = 0"),
    "range_scan": (range_scan, f"WITH {LOG}, {TOP} SELECT key, value FROM top WHERE op = 0 AND key >= 'click:2' AND key < 'purchase:3' ORDER BY key"),
    "run_overlap": (run_overlap, f"WITH {EVENT_RUNS} SELECT a.run AS run_a, b.run AS run_b FROM meta a JOIN meta b ON a.run < b.run AND a.smallest <= b.largest AND b.smallest <= a.largest"),
    "read_amplification": (
        read_amplification,
        f"WITH {EVENT_RUNS}, keys AS (SELECT DISTINCT key FROM log) SELECT k.key, count(m.run)::BIGINT AS runs_in_range, (SELECT count(*) FROM meta)::BIGINT AS runs_total FROM keys k LEFT JOIN meta m ON k.key >= m.smallest AND k.key <= m.largest GROUP BY 1",
    ),
    "encoded_entries": (
        encoded_entries,
        f"WITH {LOG} SELECT seq, lpad(op::VARCHAR, 2, '0') || {_le32('seq')} || {_le32('strlen(key)')} || {_le32('coalesce(strlen(value), 0)')} || hex(encode(key)) || hex(encode(coalesce(value, ''))) AS entry FROM log",
    ),
    "duration_text": (
        duration_text,
        "SELECT event_id, CASE WHEN ms >= 1000 THEN printf('%.2f s', n / 1e9) WHEN ms < 0.01 THEN printf('%.2f us', n / 1e3) ELSE printf('%.2f ms', ms) END AS took FROM (SELECT event_id, event_id * 262144 AS n, event_id * 262144 / 1e6 AS ms FROM events)",
    ),
}


CATALOGUE |= STORED


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
