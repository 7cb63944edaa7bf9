"""Near-duplicate components by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles gives a signature of 64 symbols. Pairs of the asked Jaccard similarity
differ in few symbols: the distance bound is the one that a pair at the threshold exceeds with
probability 1e-5 at most. By the pigeonhole principle, if the signature is cut into enough chunks, some
chunk of a pair within the bound has one differing symbol at most; each chunk is therefore keyed once
for each symbol left out (the allowed error), and all pairs within the bound share a key. Runs of equal
keys are joined by signature distance into clusters, and inside clusters pairs are confirmed on the full
shingle sets.

Skew. Equal sets are one class before anything is joined, found by an aggregation that combines before
the exchange. A run larger than RUN_BLOCK becomes one cluster with its hub, one of its texts, without
comparing signatures: what isn't linked parts again when the sets are compared. A cluster larger than a block
of CLUSTER_ROWS rows or CLUSTER_BYTES of text is cut into blocks, and HUBS of its texts are added to each, so
that what is linked with them, directly or through others, comes together over all blocks. The largest
component found so is not compared with itself again; the texts outside of it are compared with all blocks, a
block of them with one of the others at a time. Within a block a text is compared with all others at once,
through an index of the block's shingles, and only if one of its rarest shingles is shared: of a text's
shingles, so many that a link can't avoid them all. Texts are taken until those left are in one component, so
a block of copies takes one step. A group of copies thus costs as much as it has rows (one that is mostly not
linked still costs each pair of its blocks), and no task holds more than two blocks. A group emits a spanning
forest of its links, never all pairs.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle; rows without doc_id get n_shingles and no component,
and are kept; rows that repeat a doc_id are each linked as their text is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from keystrata.llm.common import arrow_schema, as_batch, components, grouped, lean, map_text, materialize, mix64, release, releasing, shingles, text_slices, unused

SYMBOLS = 64
#: Rows of a run whose signatures are compared; rows and text of a cluster in one block, and texts in each block of a cluster.
RUN_BLOCK, CLUSTER_ROWS, CLUSTER_BYTES, HUBS = 4096, 2048, 4 << 20, 8


#: Ids that are sent to all tasks at most: eight bytes each, about thirty in a task's table.
BROADCAST_IDS = 1 << 20


@dataclass(frozen=True)
class Threshold:
    """Links have 100 * |A and B| >= percent * |A or B|, on shingles of so many words."""

    words: int = 5
    percent: int = 80

    @cached_property
    def distance(self) -> int:
        """Symbols that may differ, so that a pair at the threshold is beyond it in 1 of 100,000 cases at most."""
        q, tail = 1 - self.percent / 100, 0.0
        for d in range(SYMBOLS, -1, -1):
            tail += math.comb(SYMBOLS, d) * q**d * (1 - q) ** (SYMBOLS - d)
            if tail > 1e-5:
                return d
        return 0

    @cached_property
    def chunks(self) -> list[np.ndarray]:
        """With m chunks and one error allowed in each, pairs within 2 m - 1 symbols share a key."""
        return np.array_split(np.arange(SYMBOLS), max(1, math.ceil((self.distance + 1) / 2)))


_FAMILY = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols, one row per text; texts without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        starts, h = offsets[:-1][full], np.empty_like(values)
        with np.errstate(over="ignore"):
            for j in range(SYMBOLS):
                np.multiply(values, _FAMILY[j], out=h)
                out[full, j] = (mix64(np.minimum.reduceat(h, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, t: Threshold) -> np.ndarray:
    """All keys of each signature, one row per signature."""
    s, keys = sig.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for c, chunk in enumerate(t.chunks):
            for out in range(len(chunk)):
                h = np.full(len(s), c * SYMBOLS + out + 1, np.uint64)
                for j in np.delete(chunk, out):
                    h = mix64((h ^ s[:, j]) * np.uint64(0x9E3779B97F4A7C15))
                keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def forest(n: int, near: Callable[[int], np.ndarray], todo: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of a relation over 0..n-1, and each number's component. near(i) marks what i
    is related to. Numbers are asked one by one, the first one first. One whose component holds all numbers
    that it could still be related to is not asked: those not asked yet, or, where only the numbers of todo are
    asked about the others, all others."""
    root, out = np.arange(n), []
    others = np.zeros(n, bool) if todo is None else ~todo
    todo = ~others
    left = np.bincount(root[todo], minlength=n)
    while todo.any():
        if others.any():
            other = root[others]
            ask = np.flatnonzero(todo & ((root != other[0]) | (other != other[0]).any()))
        else:
            ask = np.flatnonzero(todo & (root != left.argmax())) if out else np.flatnonzero(todo)
        if not len(ask):
            break
        i = int(ask[0])
        todo[i] = False
        left[root[i]] -= 1
        js = np.flatnonzero(near(i) & (root != root[i]))
        if not len(js):
            continue
        # One edge to each component that is reached.
        reached, at = np.unique(root[js], return_index=True)
        out += [(i, int(j)) for j in js[at]]
        left[root[i]] += left[reached].sum()
        left[reached] = 0
        root[np.isin(root, reached)] = root[i]
    return out, root


def _near_forest(sig: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose symbols differ in bound places at most."""
    return forest(len(sig), lambda i: (sig != sig[i]).sum(axis=1) <= bound)[0]


class Linked:
    """Links of each of some texts with all others, on the full sets, through an index of their shingles."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, percent: int) -> None:
        self.percent, n = percent, len(offsets) - 1
        sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        rows = np.repeat(np.arange(n), self.size)
        _, self.token, self.held_by = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        self.rows = rows[np.argsort(self.token, kind="stable")]
        self.starts = np.cumsum(self.held_by) - self.held_by

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of some shingles each text has."""
        n = self.held_by[tokens]
        at = np.arange(int(n.sum())) + np.repeat(self.starts[tokens] - (np.cumsum(n) - n), n)
        return np.bincount(self.rows[at], minlength=len(self.size))

    def near(self, i: int) -> np.ndarray:
        own = self.token[self.ends[i] : self.ends[i + 1]]
        # A text linked with i has percent of i's shingles at least, so it has one of any more than the rest.
        few = len(own) * (100 - self.percent) // 100 + 1
        if few < len(own) and (self.shared(own[np.argpartition(self.held_by[own], few - 1)[:few]]) > 0).sum() < 2:
            return np.zeros(len(self.size), bool)
        both = self.shared(own)
        return (both > 0) & (100 * both >= self.percent * (self.size[i] + self.size - both))


def _links(values: np.ndarray, offsets: np.ndarray, t: Threshold, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among texts, or of those between side 0 and side 1."""
    x = Linked(values, offsets, t.percent)
    if side is None:
        return forest(len(x.size), x.near)[0]
    return forest(len(x.size), lambda i: x.near(i) & (side != side[i]), side == 0)[0]


def _sets(docs: DataFrame, t: Threshold) -> DataFrame:
    """(doc_id, n_shingles, bytes, digest of the set, signature)."""

    def run(s: pa.RecordBatch) -> dict:
        texts = s.column("text").to_pylist()
        values, offsets = shingles(texts, t.words)
        sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        sig = signatures(values, offsets)
        return {
            "doc_id": s.column("doc_id"),
            "n_shingles": [len(x) for x in sets],
            "bytes": [len(x) if x else 0 for x in texts],
            "digest": [xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
            "sig": [row.tobytes() for row in sig],
        }

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_shingles long, bytes long, digest binary, sig binary", run)


RUN, EDGE = "key long, id long, star long", "a long, b long"


def _runs(classes: DataFrame, t: Threshold) -> DataFrame:
    """(key, id, star): the runs of equal keys with two classes at least. star is the hub of a run that is
    larger than RUN_BLOCK, else null."""
    keyed = arrow_schema("key long, id long")

    def key(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                sig = np.frombuffer(b"".join(s.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                ks = chunk_keys(sig, t)
                yield as_batch(keyed, {"key": ks.ravel(), "id": np.repeat(s.column("id").to_numpy(zero_copy_only=False), ks.shape[1])})

    schema = arrow_schema(RUN)

    def run(batches):
        # The rows of the last key so far, while they are RUN_BLOCK at most; beyond that its hub.
        held, size, last, hub = [], 0, None, None

        def small(k: np.ndarray, ids: np.ndarray):
            return as_batch(schema, {"key": k, "id": ids, "star": pa.nulls(len(k), pa.int64())})

        def large(k, ids: np.ndarray, hub: int):
            return as_batch(schema, {"key": np.full(len(ids), k), "id": ids, "star": np.full(len(ids), hub)})

        def ended():
            if last is not None and hub is None and size > 1:
                yield small(np.full(size, last), np.concatenate(held))

        for b in batches:
            if not b.num_rows:
                continue
            k, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            n = np.diff(cut)
            first = 0
            if k[0] == last:
                # The run of the batch before goes on.
                held.append(ids[: n[0]])
                size, first = size + int(n[0]), 1
                if hub is None and size > RUN_BLOCK:
                    hub = int(held[0][0])
                if hub is not None:
                    for part in held:
                        yield large(last, part, hub)
                    held = []
                if len(n) == 1:
                    continue
            yield from ended()
            # Runs that begin and end in this batch.
            whole = np.zeros(len(n), bool)
            whole[first:-1] = True
            keep = np.repeat(whole & (n > 1) & (n <= RUN_BLOCK), n)
            yield small(k[keep], ids[keep])
            for r in np.flatnonzero(whole & (n > RUN_BLOCK)):
                yield large(k[cut[r]], ids[cut[r] : cut[r + 1]], int(ids[cut[r]]))
            last, held, size, hub = k[-1], [ids[cut[-2] :]], int(n[-1]), None
            if size > RUN_BLOCK:
                hub = int(held[0][0])
                yield large(last, held[0], hub)
                held = []
        yield from ended()

    dealt = classes.select("id", "sig").mapInArrow(lean(key), "key long, id long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(run), RUN)


def _near_edges(runs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """(a, b): classes of a run whose signatures are within the bound, as spanning forests; and the stars."""
    schema = arrow_schema(EDGE)
    # Eight bits of each symbol: distances can only shrink, so no pair within the bound is lost.
    few = classes.select("id", F.unhex(F.regexp_replace(F.hex("sig"), "(..)..", "$1")).alias("sig"))

    def within(batches):
        a, b = [], []
        for g in grouped(batches, ["key"]):
            ids = g.column("id").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(g.num_rows, -1)
            for x, y in _near_forest(sig, t.distance):
                a.append(ids[x])
                b.append(ids[y])
            if len(a) > 50_000:
                yield as_batch(schema, {"a": a, "b": b})
                a, b = [], []
        yield as_batch(schema, {"a": a, "b": b})

    dealt = runs.where("star is null").select("key", "id").join(few, "id").repartition("key").sortWithinPartitions("key")
    stars = runs.where("star <> id").select(F.col("star").alias("a"), F.col("id").alias("b"))
    return dealt.mapInArrow(lean(within), EDGE).unionByName(stars).distinct()


def _against_all(loose: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, block, part, side, id): each part of a key's loose ids (side 0) with each block of its ids (side 1).
    loose is (key, id, bytes); blocks is (key, block, id)."""
    parts = loose.groupBy("key").agg(_blocks().alias("parts"))
    many = blocks.join(parts, "key", "left_semi").groupBy("key").agg((F.max("block") + 1).alias("many"))
    to = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    all_ = blocks.join(parts, "key").select("key", "block", "id", to).withColumn("side", F.lit(1))
    few = loose.join(parts, "key").join(many, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    few = few.select("key", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), "id", "part").withColumn("side", F.lit(0))
    return all_.unionByName(few).select("key", "block", "part", "side", "id")


def _blocks() -> Column:
    """How many blocks the rows of a group take, by their number and their bytes."""
    return F.greatest(F.lit(1), F.ceil(F.sum("bytes") / CLUSTER_BYTES), F.ceil(F.count("*") / CLUSTER_ROWS)).cast("int")


def _confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, t: Threshold, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links between classes of one cluster, confirmed on the full sets."""
    found_schema, schema = arrow_schema("a long, b long, many boolean"), arrow_schema(EDGE)
    members = keep(clusters.join(classes.select("id", "bytes"), "id").select(F.col("component").alias("key"), "id", "bytes"))
    sizes = keep(members.groupBy("key").agg(_blocks().alias("blocks")))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = keep(placed.where("blocks > 1").select("key", "blocks", "block", "id", "bytes"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(3)), "id"))
    hubs = keep(many.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("key", "blocks", "id"))
    to_all = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", F.lit(True).alias("many"), F.lit(True).alias("hub"))
    others = placed.join(hubs.select("id"), "id", "left_anti").select("key", "block", "id", (F.col("blocks") > 1).alias("many"), F.lit(False).alias("hub"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")

    def sets(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = [], [0]
        for batch in g.select(["text"]).to_batches():
            for s in text_slices(batch):
                v, o = shingles(s.column("text").to_pylist(), t.words)
                values.append(v)
                offsets.extend((o[1:] + offsets[-1]).tolist())
        return np.concatenate(values), np.array(offsets)

    def within(batches):
        for g in grouped(batches, ["key", "block"]):
            if g.num_rows > 1:
                # Hubs first: most of a group of copies is linked with them at once.
                g = g.take(np.argsort(~g.column("hub").to_numpy(), kind="stable"))
                ids, edges = g.column("id").to_numpy(), _links(*sets(g), t)
                yield as_batch(found_schema, {"a": [ids[x] for x, _ in edges], "b": [ids[y] for _, y in edges], "many": [g.column("many")[0].as_py()] * len(edges)})

    def across(batches):
        for g in grouped(batches, ["key", "block", "part"]):
            ids, side = g.column("id").to_numpy(), g.column("side").to_numpy()
            edges = _links(*sets(g), t, side) if side.min() != side.max() else []
            yield as_batch(schema, {"a": [ids[x] for x, _ in edges], "b": [ids[y] for _, y in edges]})

    found = keep(text.join(to_all.unionByName(others), "id").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(lean(within), "a long, b long, many boolean"))
    edges = found.select("a", "b")
    if many.isEmpty():
        return edges
    now = keep(components(found.where("many").select("a", "b")))
    parted = keep(many.join(now, "id", "left").select("key", "id", "bytes", F.coalesce("component", "id").alias("component")))
    largest = parted.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    loose = keep(parted.join(largest, "key").where("component <> largest").select("key", "id", "bytes"))
    if not loose.isEmpty():
        by = ["key", "block", "part"]
        edges = edges.unionByName(text.join(_against_all(loose, many.select("key", "block", "id")), "id").repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(across), EDGE))
    return edges


def near_duplicates(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept; as a stored table."""
    with releasing() as keep:
        sets = keep(_sets(docs, t))
        linkable = sets.where("doc_id is not null and digest is not null")
        classes = keep(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "bytes", "sig")).alias("c")).select("digest", F.col("c.doc_id").alias("id"), "c.bytes", "c.sig"))
        runs = materialize(_runs(classes, t))
        near = materialize(_near_edges(runs, classes, t))
        release(runs)
        clusters = keep(components(near))
        release(near)
        links = keep(_confirmed(docs, classes, clusters, t, keep))
        linked = keep(components(links))
        root = keep(classes.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")))
        known = linkable.join(root, "digest").select("doc_id", "n_shingles", "component_id")
        alone = sets.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return materialize(known.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def near_dedup_stage(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """The documents that stay: the first of each component. All columns stay. Up to BROADCAST_IDS ids of the
    others are sent to all tasks, and the documents stay where they are; more are joined by an exchange."""
    gone = unused(docs.columns, "gone")
    ids = near_duplicates(docs, t).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
