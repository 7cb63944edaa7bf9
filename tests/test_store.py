import random
import threading

import pytest

from keystrata import Store, cli, store
from keystrata.model import DELETE, PUT, IncompleteEntry, InvalidKey, KeyNotFound
from keystrata.operators import segments
from keystrata.operators.manifest import FileMeta, Version, parse_manifest
from keystrata.sources import codec
from keystrata.sources.datasource import between, lookup, register
from keystrata.streaming.ingest import ingest, live_state


def rows(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


def test_flush_reopen_and_newest_wins(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=2, batch_size=1)
    s.write([(PUT, "apple", "v1"), (PUT, "banana", "b"), (PUT, "cherry", "c"), (PUT, "apple", "v2"), (PUT, "date", "d"), (PUT, "elderberry", "e")])
    assert [f.number for f in s.version.levels[0]] == [0, 1]
    assert s.get("apple") == b"v2" and s.get("date") == b"d"
    s.delete("banana")
    with pytest.raises(KeyNotFound):
        s.get("banana")
    with pytest.raises(InvalidKey):
        s.put("", "x")
    again = Store.open(spark, str(tmp_path / "s"), flush_threshold=2, batch_size=1)
    assert rows(again.scan()) == {"apple": "v2", "cherry": "c", "date": "d", "elderberry": "e"}
    again.put("apple", "")
    assert again.get("apple") == b""
    again.flush()
    again.compact(0)
    assert again.version.levels[0] == () and rows(again.scan())["apple"] == ""
    assert any(p.endswith("0.sst") for p in again.vacuum())
    status = {bytes(r.key): r.status for r in again.multi_get(spark.createDataFrame([("apple",), ("nope",)], "key string")).collect()}
    assert status == {b"apple": "FOUND", b"nope": "ABSENT"}
    again.clear()
    assert again.scan().count() == 0


def test_concurrent_writers_share_commits(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=50)
    ts = [threading.Thread(target=lambda w=w: s.write([(PUT, f"w{w}_k{i}", f"v{i}") for i in range(20)])) for w in range(5)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    got = rows(s.scan())
    assert got == {f"w{w}_k{i}": f"v{i}" for w in range(5) for i in range(20)}


def test_random_segmentation_is_flat_latest(spark, tmp_path):
    rng = random.Random(7)
    want, muts = {}, []
    for i in range(120):
        k = f"k{rng.randrange(12)}"
        if rng.random() < 0.3:
            muts.append((DELETE, k))
            want.pop(k, None)
        else:
            muts.append((PUT, k, str(i)))
            want[k] = str(i)
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=5, batch_size=40)
    s.write(muts)
    assert rows(s.scan()) == want


def test_codec_and_sources(spark, tmp_path):
    entries = [(i, PUT if i % 5 else DELETE, b"%04d" % i, b"v%d" % i if i % 5 else None) for i in range(138)]
    data = codec.encode_run(entries, 0.01)
    run = codec.Run(data)
    assert len(run.index) == 3 and list(run.scan()) == entries and run.get(b"0064") == entries[64] and run.get(b"00645") is None
    assert codec.encode(1, 0, b"a", b"A") == bytes([0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]) + b"aA"
    with pytest.raises(IncompleteEntry):
        list(codec.decode(data[:7]))
    assert list(codec.decode(codec.encode(1, 0, b"a", b"A") + b"\0\0", permissive=True)) == [(1, 0, b"a", b"A")]
    register(spark)
    df = spark.createDataFrame([(e[0], e[1], bytearray(e[2]), bytearray(e[3]) if e[3] else None) for e in entries], "seq long, op int, key binary, value binary").coalesce(1)
    for fmt in ("entrylog", "sortedrun"):
        df.write.format(fmt).mode("append").save(str(tmp_path / fmt))
        back = spark.read.format(fmt).load(str(tmp_path / fmt)).orderBy("ord").collect()
        assert [(r.seq, r.op, bytes(r.key), bytes(r.value) if r.value is not None else None) for r in back] == entries


def test_run_source_reads_by_key(spark, tmp_path):
    entries = [(i, PUT, b"%05d" % (2 * i), b"v%d" % i) for i in range(1000)]
    path = tmp_path / "runs"
    path.mkdir()
    (path / "0.sst").write_bytes(codec.encode_run(entries, 0.01))
    data = (path / "0.sst").read_bytes()
    asked = []
    run = codec.Run(size=len(data), read_at=lambda at, n: asked.append(n) or data[at : at + n])
    assert list(run.scan()) == entries and run.find(b"00100") == (50, entries[50]) and run.find(b"00101") is None
    asked.clear()
    assert [e[2] for e in run.scan(b"00700", b"00710")] == [b"%05d" % k for k in range(700, 711, 2)] and len(asked) == 1
    register(spark)
    keys = lambda df: [bytes(r.key) for r in df.orderBy("key").collect()]
    assert keys(lookup(spark, str(path), [b"00100"])) == [b"00100"] and keys(lookup(spark, str(path), [b"00101"])) == keys(lookup(spark, str(path), [])) == []
    assert keys(lookup(spark, str(path), [b"00002", b"00003", b"01998", b""])) == [b"00002", b"01998"]
    assert keys(between(spark, str(path), b"00701", b"00710")) == [b"%05d" % k for k in range(702, 711, 2)] and keys(between(spark, str(path), high=b"00003")) == [b"00000", b"00002"]
    assert lookup(spark, str(path), [b"00100"]).first().ord == 50 and between(spark, str(path)).count() == 1000
    stream = [data[: 13 + 5 + 2], data[20:50], data[50 : run.filter_at]]
    assert list(codec.decode_stream(lambda n: stream.pop(0) if stream else b"")) == entries
    torn = [data[:30]]
    with pytest.raises(IncompleteEntry):
        list(codec.decode_stream(lambda n: torn.pop(0) if torn else b""))


def test_bloom_params_and_rate():
    from keystrata.functions.bloom import params

    assert params(100, 0.01)[1] == 7 and params(256, 0.01) == (2454, 7) and params(100, 0.001) == (1438, 10)
    b = codec.Bloom.sized(1000, 0.01)
    [b.add(i.to_bytes(4, "little")) for i in range(1000)]
    assert all(b.may_contain(i.to_bytes(4, "little")) for i in range(1000))
    assert sum(b.may_contain(i.to_bytes(4, "little")) for i in range(1000, 6000)) <= 150
    assert codec.Bloom.decode(b.encode()).data == b.data


def test_manifest(spark):
    f = lambda n: FileMeta(n, b"a", b"\xff")
    v = Version.empty(4).apply({0: [f(1), f(2), f(3)], 1: [f(10), f(11)]})
    w = v.apply({1: [f(20), f(21)]}, {0: {1, 2}, 1: {10}})
    assert [[x.number for x in level] for level in w.levels] == [[3], [11, 20, 21], [], []] and w.next_run == 22
    assert len(v.levels[0]) == 3 and w.apply({}, {1: {20, 21}}).next_run == 22
    with pytest.raises(IndexError):
        v.apply({9: [f(1)]})
    assert Version.from_json(w.to_json()) == w
    got = parse_manifest(spark.createDataFrame([(w.to_json(),)], "value string")).collect()
    assert {(r.level, r.file_no, bytes(r.largest)) for r in got} == {(0, 3, b"\xff"), (1, 11, b"\xff"), (1, 20, b"\xff"), (1, 21, b"\xff")}


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "a", "1"), (2, 0, "b", "2"), (3, 1, "a", None)], "ord long, op int, key string, value string").write.parquet(src)
    s = Store.open(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema("ord long, op int, key string, value string").parquet(src)
    ingest(stream, s, str(tmp_path / "cp")).awaitTermination()
    assert rows(s.scan()) == {"b": "2"}
    s.append(spark.createDataFrame([(1, 0, "z", "1")], "ord long, op int, key string, value string"), "ord", stream="ingest", batch_id=0)
    assert rows(s.scan()) == {"b": "2"}
    q = live_state(stream.withColumnRenamed("ord", "seq")).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.key, r.value) for r in spark.table("live").collect()] == [("b", "2")]


def test_segments_by_shard(spark):
    log = spark.createDataFrame([(i, s, f"k{i}") for s in "ab" for i in range(7)], "seq long, shard string, key string")
    got = segments.flush_segments(log, 3, shard="shard").groupBy("shard", "segment").count().collect()
    assert sorted((r.shard, r.segment, r["count"]) for r in got) == [(s, g, n) for s in "ab" for g, n in ((0, 3), (1, 3), (2, 1))]


def test_cli(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    assert cli.dispatch(s, "PUT k v") == "ok" and cli.dispatch(s, "get k") == "v" and cli.dispatch(s, "get q") == "not found"
    assert "52 pairs" in cli.dispatch(s, "seed 2") and cli.dispatch(s, "get apple1") == "artichoke1"
    assert cli.dispatch(s, "flush") == "ok" and "0.sst" in cli.dispatch(s, "inspect") and "total 53" in cli.dispatch(s, "dump sstable/0/0.sst")
    assert "sstable/0/0.sst" in cli.complete(s, "sst")
    assert "L1: (empty)" in cli.dispatch(s, "inspect") and "L0: 53 entries" in cli.dispatch(s, "inspect") and "1 blocks\nblock 0: offset 0, first key apple0" in cli.dispatch(s, "inspect sstable/0/0.sst")
    assert [r.key for r in s.range_scan("a", "b", reverse=True).collect()] == [b"apple1", b"apple0"]
    s.files.delete(s.paths.run(0, 0))
    assert {(r.tier, r["name"], r.entries, r.status, r.tier_entries) for r in s.inspect().collect() if r.tier == "L0"} == {("L0", "0.sst", None, "error", 0)}
    saved = cli.History(s.files, f"{s.paths.base}/.history")
    saved.add("put a b")
    saved.save()
    assert cli.History(s.files, f"{s.paths.base}/.history").lines == ["put a b"]
    h = cli.History()
    [h.add(x) for x in ["a", "a", "b", *map(str, range(1200))]]
    assert len(h.lines) == 1000 and h.last(1) == ["1199"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_bulk_numbers_are_dense_and_in_order(spark, adaptive):
    from pyspark.sql import functions as F

    from keystrata.operators.ordered import numbered, ranged

    n = 2_000_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(n).select(((F.col("id") * 1_000_003) % n).alias("ord"), F.rand(1).alias("x")).repartition(64)
        out = numbered(ranged(rows, "ord"), "n")
        assert tuple(out.agg(F.count("*"), F.countDistinct("n"), F.count_if(F.col("n") == F.col("ord") + 1)).first()) == (n, n, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_bulk_append_keeps_all_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    s = Store.open(spark, str(tmp_path / "s"))
    s.put("first", "1")
    rows = spark.range(100_000).select(F.col("id").alias("ord"), F.lit(PUT).alias("op"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"))
    s.append(rows.orderBy(F.rand(3)).repartition(64), "ord")
    got = s.wal().where("seq > 1").select("seq", F.expr("cast(substr(cast(key as string), 2) as long) + 2").alias("want"))
    assert got.count() == 100_000 and got.where("seq <> want").count() == 0 and s.scan().count() == 100_001
    s.put("last", "1")
    assert s.wal().agg(F.max("seq")).first()[0] == 100_002
    s.append(rows.limit(0), "ord")
    assert Store.open(spark, str(tmp_path / "s")).scan().count() == 100_002


@pytest.mark.parametrize("where", ["written", "marked"])
def test_replayed_batch_after_a_crash(spark, tmp_path, monkeypatch, where):
    batch = spark.createDataFrame([(1, 0, "a", "1"), (2, 0, "b", "2")], "ord long, op int, key string, value string")
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=2)
    s.append(batch.limit(0), "ord", stream="x", batch_id=0)
    mark = Store._mark

    def crash(self, name, entries):
        if where == "marked":
            mark(self, name, entries)
        raise OSError("crash")

    monkeypatch.setattr(Store, "_mark", crash)
    with pytest.raises(OSError):
        s.append(batch, "ord", stream="x", batch_id=1)
    monkeypatch.undo()
    again = Store.open(spark, str(tmp_path / "s"), flush_threshold=2)
    assert again.wal().count() == (2 if where == "marked" else 0)
    again.append(batch, "ord", stream="x", batch_id=1)
    assert sorted(r.seq for r in again.wal().collect()) == [1, 2] and again.scan().count() == 2
    again.put("c", "3")  # flushes; the batch is remembered by the manifest from now on
    third = Store.open(spark, str(tmp_path / "s"), flush_threshold=2)
    third.append(batch, "ord", stream="x", batch_id=1)
    assert third.log().count() == 3


def test_interrupted_batches_are_not_read(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put("a", "1")
    s._write_batch(spark.createDataFrame([(2, 0, bytearray(b"b"), bytearray(b"2"))], "seq long, op int, key binary, value binary"), "batch=torn")
    assert rows(s.scan()) == {"a": "1"} and rows(Store.open(spark, str(tmp_path / "s")).scan()) == {"a": "1"}
    assert any("torn" in p for p in s.vacuum()) and rows(s.scan()) == {"a": "1"}


def test_segments_in_batches(spark):
    rng = random.Random(9)
    log = [(i + 1, f"k{rng.randrange(30)}") for i in range(700)]
    for size in (1, 7, 50):
        keys, segment, want = set(), 0, {}
        for at in range(0, len(log), size):
            if len(keys) >= 20:
                keys, segment = set(), segment + 1
            for seq, k in log[at : at + size]:
                keys.add(k)
                want[seq] = segment
        segments.SPREAD, before = 64, segments.SPREAD
        got = {r.seq: r.segment for r in segments.flush_segments(spark.createDataFrame(log, "seq long, key string").repartition(5), 20, batch_size=size).collect()}
        segments.SPREAD = before
        assert got == want


def test_history_across_partitions(spark):
    rng = random.Random(10)
    cmds = [(i, rng.choice([None, "a", "b", "b", "b"])) for i in range(500)]
    kept = [c for n, c in enumerate(cmds) if not n or cmds[n - 1][1] != c[1]][-60:]
    got = segments.keep_last(spark.createDataFrame(cmds, "ord long, cmd string").repartition(7), 60).collect()
    assert [tuple(r) for r in got] == kept


def test_compaction_by_overlap(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=1000)
    for keys in (["a", "b"], ["m", "n"], ["n", "o"]):
        s.write([(PUT, k, keys[0]) for k in keys])
        s.flush()
        s.compact(0)
    # The first run of level 1 meets neither of the others and stays as it is; the others are one.
    assert [(f.number, f.smallest, f.largest) for f in s.version.levels[1]] == [(1, b"a", b"b"), (5, b"m", b"o")]
    s.delete("b")
    s.delete("zz")
    s.flush()
    s.compact(0)
    assert rows(s.scan()) == {"a": "a", "m": "m", "n": "n", "o": "n"} and s.log().where("op = 1").count() == 0
    for i in range(6):
        s.put(f"k{i}", "v")
        s.flush()
    before = s.metrics()
    assert (before["l0_runs"], before["l0_entries"], before["compaction_debt"], before["log_entries"]) == (6, 6, 6, 0)
    assert s.maintain(max_runs=8) == [] and s.maintain(max_runs=5) == [0] and s.metrics()["compaction_debt"] == 0
    assert rows(s.scan()) == {"a": "a", "m": "m", "n": "n", "o": "n"} | {f"k{i}": "v" for i in range(6)}


def test_bloom_sent_and_joined(spark, monkeypatch):
    from pyspark.sql import functions as F

    from keystrata.functions import bloom

    have = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    asked = spark.range(400, 1500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    m, k = bloom.params(500, 0.05)
    bits = bloom.bit_set(have, m, k)
    sent = sorted(map(tuple, bloom.may_contain(bits, asked, m, k).collect()))
    monkeypatch.setattr(bloom, "PACKED_BITS", 0)
    assert sorted(map(tuple, bloom.may_contain(bits, asked, m, k).collect())) == sent
    python = codec.Bloom(m, k)
    [python.add(b"k%d" % i) for i in range(500)]
    assert dict(sent) == {f"k{i}": python.may_contain(b"k%d" % i) for i in range(400, 1500)}


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_queue_writes_without_jobs(spark, tmp_path, monkeypatch, limit):
    """A job for each batch and flush took 1.6 s of each 50 mutations; beyond the limit jobs flush, with the same result."""
    monkeypatch.setattr(store, "MEMTABLE_BYTES", limit)
    rng = random.Random(11)
    log = [(DELETE, f"k{rng.randrange(300)}") if rng.random() < 0.2 else (PUT, f"k{rng.randrange(300)}", f"v{n}") for n in range(1020)]
    s = Store.open(spark, str(tmp_path / "s"), flush_threshold=20, batch_size=50, batch_timeout_ms=0)
    spark.sparkContext.setJobGroup("queue", "")
    try:
        s.write(log)
        assert bool(spark.sparkContext.statusTracker().getJobIdsForGroup("queue")) == (limit == 300)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want, runs = {}, {}
    for at in range(0, len(log), 50):
        part = {m[1]: (at + i + 1, m[0], m[2] if m[0] == PUT else None) for i, m in enumerate(log[at : at + 50])}
        want |= part
        if at < 1000:
            runs[at // 50] = (min(part), max(part), len(part))
    again = Store.open(spark, str(tmp_path / "s"), flush_threshold=20, batch_size=50, batch_timeout_ms=0)
    for t in (s, again):
        assert {f.number: (f.smallest.decode(), f.largest.decode(), f.entries) for f in t.version.levels[0]} == runs
        assert t.log().count() == sum(n for *_, n in runs.values()) + 20
        assert rows(t.scan()) == {k: v for k, (_, op, v) in want.items() if op == PUT}
    assert again.get(next(k for k, (n, op, _) in want.items() if op == PUT and n > 1000)).startswith(b"v10")
    assert again.inspect().where("status = 'ok'").count() == len(runs) + 2
    again.flush()  # of a reopened store: by a job
    again.put("zz", "1")
    again.append(spark.createDataFrame([(1, PUT, "zz", "2"), (2, PUT, "zzz", "3")], "ord long, op int, key string, value string"), "ord")
    again.flush()  # of a log with a bulk load
    again.compact(0)
    assert rows(again.scan()) == {k: v for k, (_, op, v) in want.items() if op == PUT} | {"zz": "2", "zzz": "3"}
