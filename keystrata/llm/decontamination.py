"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so the two signatures are not
compared. Instead an item's MinHash sample (the shingle that is smallest under each of k hash functions)
is looked up in the document: each sampled shingle of an item contained to the share c is present with
probability c, whatever the document's length. Items are partitioned by their number of shingles, and
each partition has its own sample size and the number of hits that an item at the threshold misses with
probability 1e-6 at most. Candidates are verified by exact containment of the item's shingle set.

Up to BLOCK_BYTES of item text, the index of all items is sent to the tasks, and documents are streamed past
it once, never shuffled. A larger benchmark stays distributed: equal item sets are one class, a bitmap of the
sampled shingles (BITMAP_BITS) thins out the documents' shingles, the rest is joined with the samples, and the
hits are added up for each text and class; candidates meet their texts again, each copied text once, and are
verified pair by pair. Both ways give the same rows.

Edge cases: a null or empty item or document has no shingles and never matches; an item of fewer words
than a shingle is one shingle and matches only documents with the same word sequence as theirs; equal
items are each reported; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from keystrata.llm.common import arrow_schema, as_batch, keep_rows, map_text, materialize, mix64, releasing, shingles, unused

WORDS, PERCENT = 5, 80
#: Item text that is sent to all tasks at most.
BLOCK_BYTES = 8 << 20
#: Size of the bitmap that thins out shingles before a join.
BITMAP_BITS = 1 << 26
#: Upper bounds of the item sizes (shingles) of the partitions, and their sample sizes.
PARTITIONS = ((16, 16), (64, 24), (256, 32), (1 << 62, 48))


def least_hits(k: int, percent: int) -> int:
    """Hits out of k that an item contained to the threshold falls short of with probability 1e-6 at most."""
    c, tail = percent / 100, 0.0
    for h in range(k + 1):
        tail += math.comb(k, h) * c**h * (1 - c) ** (k - h)
        if tail > 1e-6:
            return max(1, h)
    return 1


def draw(s: np.ndarray, percent: int) -> tuple[int, list[int]]:
    """The hits that an item's set needs, and its MinHash sample: the smallest shingle under each function."""
    k = next(k for bound, k in PARTITIONS if len(s) <= bound)
    with np.errstate(over="ignore"):
        pick = [int(s[(mix64(s ^ np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))).argmin()]) for j in range(1, k + 1)] if len(s) else []
    return least_hits(k, percent), pick


@dataclass(frozen=True)
class Index:
    """All items: their sets, and the sampled shingles with the items and weights they stand for."""

    items: list
    sets: list[np.ndarray]
    need: list[int]
    sampled: np.ndarray
    owners: list[list[tuple[int, int]]]
    bitmap: np.ndarray
    words: int
    percent: int

    @staticmethod
    def build(items: list, texts: list[str | None], words: int, percent: int) -> Index:
        values, offsets = shingles(texts, words)
        sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        need, owners = [], {}
        for i, s in enumerate(sets):
            hits, pick = draw(s, percent)
            need.append(hits)
            for v in set(pick):
                owners.setdefault(v, []).append((i, pick.count(v)))
        sampled = np.array(sorted(owners), np.uint64)
        bitmap = np.zeros(1 << 16, bool)
        bitmap[sampled >> np.uint64(48)] = True
        return Index(items, sets, need, sampled, [owners[int(v)] for v in sampled], bitmap, words, percent)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text number, item number, shared shingles) of every contained item."""
        values, offsets = shingles(texts, self.words)
        if not len(self.sampled) or not len(values):
            return []
        maybe = np.flatnonzero(self.bitmap[values >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.sampled, values[maybe]), len(self.sampled) - 1)
        hit = self.sampled[at] == values[maybe]
        where, which = np.searchsorted(offsets, maybe[hit], "right") - 1, at[hit]
        hits: dict[tuple[int, int], int] = {}
        for d, v in set(zip(where.tolist(), which.tolist(), strict=True)):
            for item, weight in self.owners[v]:
                hits[d, item] = hits.get((d, item), 0) + weight
        out = []
        for (d, item), n in sorted(hits.items()):
            if n >= self.need[item]:
                own = self.sets[item]
                shared = int(np.isin(own, values[offsets[d] : offsets[d + 1]]).sum())
                if 100 * shared >= self.percent * len(own):
                    out.append((d, item, shared))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")


def _fits(items: DataFrame) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] <= BLOCK_BYTES


def _index(docs: DataFrame, items: DataFrame, words: int, percent: int):
    rows = items.orderBy("item_id", "text").collect()  # BLOCK_BYTES at most
    return docs.sparkSession.sparkContext.broadcast(Index.build([r["item_id"] for r in rows], [r["text"] for r in rows], words, percent))


PAIR = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def contained(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_shared, containment)."""
    items = _items(benchmark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _fits(items):
        with releasing() as keep:
            sets, pairs = _joined(src, items, words, percent, keep)
            found = _keyed(src).select("doc_id", "k1", "k2").join(pairs, ["k1", "k2"]).join(sets.select("digest", "item_id", F.col("n").alias("n_item_shingles")), "digest")
            return materialize(found.select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")))
    held = _index(docs, items, words, percent)

    def run(s: pa.RecordBatch) -> dict:
        x, ids = held.value, s.column("doc_id").to_pylist()
        found = x.search(s.column("text").to_pylist())
        return {
            "doc_id": [ids[d] for d, _, _ in found],
            "item_id": [x.items[i] for _, i, _ in found],
            "n_item_shingles": [len(x.sets[i]) for _, i, _ in found],
            "n_shared": [n for _, _, n in found],
            "containment": [n / len(x.sets[i]) for _, i, n in found],
        }

    return map_text(src, PAIR, run)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts are named by two hashes, so that equal texts are looked at once."""
    return docs.where("text is not null").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(7))})


def _joined(docs: DataFrame, items: DataFrame, words: int, percent: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(item_id, digest, n) of the items, and (k1, k2, digest, n_shared): the texts that contain a class of items."""
    spark = docs.sparkSession

    def item(s: pa.RecordBatch) -> dict:
        values, offsets = shingles(s.column("text").to_pylist(), words)
        sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        return {"item_id": s.column("item_id"), "digest": [xxh3_128_digest(x.tobytes()) for x in sets], "n": [len(x) for x in sets], "set": [x.tobytes() for x in sets]}

    sets = keep(map_text(items, "item_id long, digest binary, n long, set binary", item).where("n > 0"))
    classes = keep(sets.groupBy("digest").agg(F.min("set").alias("set")))
    sample_schema = arrow_schema("v long, digest binary, weight int, need int")

    def sample(batches):
        for b in batches:
            out = {f.name: [] for f in sample_schema}
            for digest, x in zip(b.column("digest").to_pylist(), b.column("set").to_pylist(), strict=True):
                need, pick = draw(np.frombuffer(x, np.uint64), percent)
                for v in sorted(set(pick)):
                    for c, value in zip(out, (v - (1 << 64) if v >> 63 else v, digest, pick.count(v), need), strict=True):
                        out[c].append(value)
            yield as_batch(sample_schema, out)

    samples = keep(classes.mapInArrow(sample, "v long, digest binary, weight int, need int"))
    shift = 65 - BITMAP_BITS.bit_length()
    place = F.shiftrightunsigned("v", shift)
    marks = samples.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[marks.column("w").to_numpy()] = marks.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(bitmap)

    def thin(s: pa.RecordBatch) -> dict:
        values, offsets = shingles(s.column("text").to_pylist(), words)
        at = values >> np.uint64(shift)
        hit = np.flatnonzero(held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1)
        text = np.searchsorted(offsets, hit, "right") - 1
        # A shingle once for each text.
        found = np.unique(np.stack([text.astype(np.uint64), values[hit]], axis=1), axis=0)
        k1, k2 = (s.column(c).to_numpy(zero_copy_only=False)[found[:, 0].astype(np.int64)] for c in ("k1", "k2"))
        return {"k1": k1, "k2": k2, "v": found[:, 1].view(np.int64)}

    hits = map_text(_keyed(docs).select("k1", "k2", "text"), "k1 long, k2 long, v long", thin).distinct()
    found = hits.join(samples, "v").groupBy("k1", "k2", "digest", "need").agg(F.sum("weight").alias("w")).where("w >= need")
    candidates = keep(found.select("k1", "k2", "digest"))
    texts = keep(_keyed(docs).join(candidates.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text")))
    schema = arrow_schema("k1 long, k2 long, digest binary, n_shared long")

    def verify(batches):
        last, own = None, None
        for b in batches:
            out = {f.name: [] for f in schema}
            for k1, k2, i, digest, x in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), range(b.num_rows), b.column("digest").to_pylist(), b.column("set").to_pylist(), strict=True):
                if last != (k1, k2):
                    last, own = (k1, k2), np.unique(shingles([b.column("text")[i].as_py()], words)[0])
                mine = np.frombuffer(x, np.uint64)
                shared = int(np.isin(mine, own, assume_unique=True).sum())
                if 100 * shared >= percent * len(mine):
                    for c, value in zip(out, (k1, k2, digest, shared), strict=True):
                        out[c].append(value)
            yield as_batch(schema, out)

    pairs = texts.join(candidates, ["k1", "k2"]).join(classes, "digest").select("k1", "k2", "text", "digest", "set").sortWithinPartitions("k1", "k2")
    return sets, keep(pairs.mapInArrow(verify, "k1 long, k2 long, digest binary, n_shared long"))


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a contained item. All columns stay."""
    items = _items(benchmark)
    if not _fits(items):
        k1, k2 = (unused(docs.columns, k) for k in ("k1", "k2"))
        with releasing() as keep:
            _, pairs = _joined(docs.select("text"), items, WORDS, PERCENT, keep)
            gone = materialize(pairs.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
        # A null text has no match: its hashes are null here.
        of = lambda seed: F.when(F.col("text").isNotNull(), F.xxhash64("text", *seed))
        return docs.join(gone, (of([]) == F.col(k1)) & (of([F.lit(7)]) == F.col(k2)), "left_anti")
    held = _index(docs, items, WORDS, PERCENT)

    def clean(texts: list) -> np.ndarray:
        ok = np.ones(len(texts), bool)
        ok[[d for d, _, _ in held.value.search(texts)]] = False
        return ok

    return keep_rows(docs, clean)
