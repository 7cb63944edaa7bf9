"""Repeated 50-byte strings by prefix-free parsing and suffix arrays.

1. Parsing. A rolling hash over 24-byte windows has a trigger wherever it is smallest among the 27 windows
   of some 50-byte string, the leftmost one if several are; so every 50-byte string holds its trigger whole,
   and equal strings have the same trigger at the same place. Triggers cut the documents into phrases: the
   phrase of a trigger is what its strings hold before and with it, and the parse is the sequence of the
   phrases; what a string holds behind its trigger belongs to the phrases that follow. Only hashes of
   triggers are exchanged, packed into arrays of 12 bytes each; those that one document alone has are dropped.
2. Dictionary. The phrases of repeated triggers are cut out of the text, each with the parse behind it as far
   as the 50-byte horizon; equal ones are one entry with the smallest document that has it (an aggregation
   that combines before the exchange).
3. Suffix arrays. All phrases of a trigger are in the same shard. There the suffix array of the dictionary
   orders the suffixes of its phrases. They end in the trigger and hold it only there, so none begins another:
   the parsing is prefix-free, and two different suffixes decide the order of their strings. The suffix array
   of the parse orders what follows the triggers, up to the horizon, and decides between strings whose phrase
   suffixes are equal. Both combine into the corpus order of the trigger's strings. Neighbours in that order
   are equal if their phrase suffixes are and what follows agrees for the rest of the 50 bytes; each group
   of equal strings gets its smallest document.
4. Occurrences look up their phrase's result; bytes of strings that start in a smaller document go.

Skew. A trigger repeated within a slice of documents is one row in the exchange, however often it
occurs; a trigger with very many phrases is dealt over several shards, whose results are merged by the
strings' digests; the last lookup is a plain join that Spark splits at hot phrases.

Edge cases: a null text has no bytes; texts under 50 bytes lose nothing; documents without doc_id come
after all others; rows of the same doc_id don't remove from each other; repeated rows lose the same bytes. A
document is one row, as its text is, and so is the list of its repeated phrases: at most about twice the
bytes of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from keystrata.llm.common import arrow_schema, as_batch, grouped, map_text, materialize, mix64, release, releasing, text_slices

LENGTH, WINDOW = 50, 24
SPAN, SIDE = LENGTH - WINDOW + 1, (LENGTH - WINDOW) // 2
#: Text in a slice, text bytes per bucket of triggers, and phrases of one trigger in a shard.
SLICE_BYTES, BUCKET_BYTES, SHARD_PHRASES = 2 << 20, 16 << 20, 1 << 16
LEAST_BUCKETS = 8
#: Bits of a place among the windows looked at in a step, and strings in a step.
PLACE_BITS = 14
STEP = (1 << PLACE_BITS) - SPAN
LAST = (1 << 63) - 1
_BASE = 0x2545F4914F6CDD1D | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def window_hashes(b: np.ndarray) -> np.ndarray:
    """The rolling hash of the WINDOW bytes from each position, four bytes a digit."""
    if len(b) < WINDOW:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.ndarray(len(b) - 3, "<u4", b, strides=(1,)).astype(np.uint64)
        eight = h[:-4] * _power(4) + h[4:]
        n = len(b) - WINDOW + 1
        return (eight[:n] * _power(8) + eight[8 : 8 + n]) * _power(8) + eight[16 : 16 + n]


def _word_at(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes of b from each place as a big-endian number, whose order is that of the bytes."""
    return np.ndarray(len(b) - 7, ">u8", b, strides=(1,))[at].astype(np.uint64)


def _side(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bits of the hash of the SIDE = 8 + 5 bytes from each position, read as two words that overlap; any
    value outside the text."""
    one, other = (_word_at(b, np.clip(x, 0, len(b) - 8)) for x in (at, at + SIDE - 8))
    with np.errstate(over="ignore"):
        return mix64(mix64(one) * np.uint64(_BASE) + other) & np.uint64(0xFF)


def _smallest_windows(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the smallest window of each LENGTH bytes is, the rolling hash of each window). STEP strings at a time, whose
    numbers stay in a core's cache."""
    n = len(b) - LENGTH + 1
    at, hashes = np.empty(n, np.int32), np.empty(len(b) - WINDOW + 1, np.uint64)
    # The same bits decide everywhere, however long slice and step are; the leftmost of equal ones is taken.
    low = np.uint32((1 << PLACE_BITS) - 1)
    number = np.arange(STEP + SPAN, dtype=np.uint32)
    for x in range(0, n, STEP):
        h = window_hashes(b[x : x + STEP + LENGTH - 1])
        hashes[x : x + len(h)] = h
        with np.errstate(over="ignore"):
            m = (h * np.uint64(_BASE) >> np.uint64(32)).astype(np.uint32) & ~low | number[: len(h)]
        k = len(h) - SPAN + 1
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:k], m[SPAN - 16 : SPAN - 16 + k])
        at[x : x + k] = (m & low).view(np.int32) + np.int32(x)
    return at, hashes


def triggers(b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, sides, first start, number of starts, bytes before the trigger) of each phrase of concatenated
    texts; doc numbers each byte's text. sides: eight bits each for the SIDE bytes left and right of the trigger."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(b) - LENGTH + 1
    if n <= 0:
        return none
    at, h = _smallest_windows(b)
    valid = doc[:n] == doc[LENGTH - 1 :]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (doc[1:n] != doc[: n - 1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    where = at[starts].astype(np.int64)
    sides = _side(b, where - SIDE) << np.uint64(8) | _side(b, where + WINDOW)
    return mix64(h[where]), sides, starts, np.flatnonzero(last) - starts + 1, where - starts


def _slice_phrases(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, hash, sides, start in the text, number of starts, bytes before the trigger) of the phrases of some texts."""
    out = []
    small = [i for i, t in enumerate(texts) if LENGTH <= len(t) <= SLICE_BYTES]
    if small:
        lens = np.array([len(texts[i]) for i in small])
        b = np.frombuffer(b"".join(texts[i] for i in small), np.uint8)
        doc = np.repeat(np.arange(len(small), dtype=np.int32), lens)
        h, sides, start, n, left = triggers(b, doc)
        which = doc[start]
        out.append((np.array(small)[which], h, sides, start - (np.cumsum(lens) - lens)[which], n, left))
    for i, t in enumerate(texts):
        for at in range(0, len(t) if len(t) > SLICE_BYTES else 0, SLICE_BYTES):
            b = np.frombuffer(t[at : at + SLICE_BYTES + LENGTH - 1], np.uint8)
            h, sides, start, n, left = triggers(b, np.zeros(len(b), np.int32))
            out.append((np.full(len(h), i), h, sides, start + at, n, left))
    if not out:
        out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Kinds of rows in the exchange. A trigger with its sides that two texts of a slice have is known to be
#: repeated; one row stands for it. A trigger that many texts of a slice have is known whatever its sides.
ALONE, STANDS_FOR, KNOWN, STANDS_FOR_ANY = 0, 1, 2, 3
MANY = 64


def _pack(texts: np.ndarray, g: np.ndarray, which: np.ndarray, start: np.ndarray, n: np.ndarray, left: np.ndarray, kind: np.ndarray) -> bytes:
    """g: 48 bits of the trigger's hash and 16 of its sides. Each text's doc and rid, which texts has, are listed once."""
    there = np.zeros(len(texts), bool)
    there[which] = True
    rows, idx = texts[there], (np.cumsum(there) - 1)[which]
    head = np.array([len(g), len(rows)], np.int64)
    parts = [head, rows, g.astype(np.uint64), idx.astype(np.uint16), (idx >> 16).astype(np.uint8), (start & 0xFFFF).astype(np.uint16), (start >> 16).astype(np.uint32), (n + 32 * kind).astype(np.uint8), left.astype(np.uint8)]
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, r = np.frombuffer(blob, np.int64, 2)
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    rows = take(np.int64, 2 * r).reshape(-1, 2)
    g = take(np.uint64, n)
    idx = take(np.uint16, n).astype(np.int64)
    idx |= take(np.uint8, n).astype(np.int64) << 16
    start = take(np.uint16, n).astype(np.int64)
    start |= take(np.uint32, n).astype(np.int64) << 16
    meta = take(np.uint8, n).astype(np.int64)
    return g, rows[idx, 0], rows[idx, 1], start, meta & 31, take(np.uint8, n).astype(np.int64), meta >> 5


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cut = np.flatnonzero(new)
    return cut, np.diff(np.append(cut, len(new)))


def _several(rid: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether each run holds more than one text."""
    return np.minimum.reduceat(rid, cut) < np.maximum.reduceat(rid, cut) if len(cut) else np.zeros(0, bool)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, rid, text): the order of documents, and a mark that tells rows of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("rid"), "text")


def _bytes(s: pa.RecordBatch) -> list[bytes]:
    """The texts of a slice, as they are in its buffers."""
    return [t or b"" for t in s.column("text").cast(pa.binary()).to_pylist()]


def _trigger_rows(keyed: DataFrame, buckets: int) -> DataFrame:
    few = np.uint16 if buckets <= 1 << 16 else np.int64  # numbers of 16 bits are sorted by counting

    def run(s: pa.RecordBatch) -> dict:
        which, h, sides, start, n, left = _slice_phrases(_bytes(s))
        rows = np.stack([s.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "rid")], axis=1)
        bucket = (h % np.uint64(buckets)).astype(few)
        g = (h >> np.uint64(16) << np.uint64(16)) | sides
        order = np.argsort(g, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        g, which, start, n, left, bucket = (x[order] for x in (g, which, start, n, left, bucket))
        kind = np.full(len(g), ALONE)
        if len(g):
            rid = rows[which, 1]
            cut, sizes = _runs(g, bucket)
            several = _several(rid, cut)
            kind[np.repeat(several, sizes)] = KNOWN
            wide, wide_sizes = _runs(g >> np.uint64(16), bucket)
            hot = _several(rid, wide) & (wide_sizes > MANY)
            kind[np.repeat(hot, wide_sizes)] = KNOWN
            inside = np.repeat(hot, wide_sizes)[cut]
            reps = np.concatenate([cut[several & ~inside], wide[hot]])
            rep_kind = np.repeat([STANDS_FOR, STANDS_FOR_ANY], [int((several & ~inside).sum()), int(hot.sum())])
            # Known rows only pass through, spread by their text; copies of a text stay together.
            spread = (mix64(rows[:, 1].view(np.uint64)) % np.uint64(buckets)).astype(few)[which]
            bucket = np.concatenate([np.where(kind == KNOWN, spread, bucket), bucket[reps]])
            kind = np.concatenate([kind, rep_kind])
            g, which, start, n, left = (np.concatenate([x, x[reps]]) for x in (g, which, start, n, left))
            order = np.argsort(bucket, kind="stable")
            g, which, start, n, left, kind, bucket = (x[order] for x in (g, which, start, n, left, kind, bucket))
        cut, sizes = _runs(bucket)
        return {"bucket": bucket[cut], "blob": [_pack(rows, *(x[a : a + k] for x in (g, which, start, n, left, kind))) for a, k in zip(cut, sizes, strict=True)]}

    target = arrow_schema("bucket int, blob binary")

    def stream(batches):
        for b in batches:
            for s in text_slices(b, "text", SLICE_BYTES):
                yield as_batch(target, run(s))

    return keyed.mapInArrow(stream, "bucket int, blob binary")


REPEATED = "doc long, rid long, h long, start long, n int, left int"


def _repeated(rows: DataFrame, buckets: int) -> DataFrame:
    """Phrases that may hold a string which another text has too: their trigger is in both, and SIDE bytes to
    its left or to its right are, as a common string has LENGTH - WINDOW = 2 SIDE bytes besides it. Of equal
    texts in one bucket only the first document's stay."""
    schema = arrow_schema(REPEATED)

    def run(batches):
        for group in grouped(batches, ["bucket"]):
            g, doc, rid, start, n, left, kind = (np.concatenate(x) for x in zip(*map(_unpack, group.column("blob").to_pylist()), strict=True))
            take = kind == KNOWN
            rest = np.flatnonzero(~take)
            h = g >> np.uint64(16)
            for key in (g >> np.uint64(8), (h << np.uint64(8)) | (g & np.uint64(0xFF))):
                order = rest[np.argsort(key[rest])]
                cut, sizes = _runs(key[order])
                # A row that stands for two texts bears the mark of one: other rows of that text count too.
                stands = np.logical_or.reduceat(kind[order] == STANDS_FOR, cut) if len(cut) else np.zeros(0, bool)
                take[order[np.repeat(_several(rid[order], cut) | stands, sizes)]] = True
            anywhere = np.unique(h[kind == STANDS_FOR_ANY])
            take |= np.isin(h, anywhere)
            take &= (kind == ALONE) | (kind == KNOWN)
            at = np.flatnonzero(take)
            at = at[np.lexsort((start[at], rid[at]))]
            cut, _ = _runs(rid[at], start[at])
            doc = np.minimum.reduceat(doc[at], cut) if len(cut) else doc[:0]
            at = at[cut]
            for i in range(0, len(at), 100_000):
                j = at[i : i + 100_000]
                yield as_batch(schema, {"doc": doc[i : i + 100_000], "rid": rid[j], "h": h[j].astype(np.int64), "start": start[j], "n": n[j], "left": left[j]})

    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, REPEATED)


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc, rid) of the rows whose whole text a smaller document has, LENGTH bytes at least."""
    with releasing() as keep:
        ids = keep(keyed.where(F.octet_length("text") >= LENGTH).select("doc", "rid", F.xxhash64("text", F.lit(7)).alias("second"), F.octet_length("text").alias("size")))
        first = keep(ids.groupBy("rid", "second", "size").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
        return materialize(ids.join(first, ["rid", "second", "size"]).where("doc > first").select("doc", "rid").distinct())


PHRASE = "doc long, rid long, start long, n int, left int, h long, c long, low long, phrase binary"


def _phrases(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each occurrence of a phrase, which (h, c) names. Within a slice of documents its text, with
    the parse behind it up to the horizon, is given once, with the smallest document of the slice that has it."""
    lists = repeated.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "n", "h", "left")).alias("found"))
    joined = keyed.join(lists, ["doc", "rid"])

    def run(s: pa.RecordBatch) -> dict:
        lists = s.column("found")
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        start, n, h, left = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        at, phrase = 0, []
        for t, size in zip(_bytes(s), sizes.tolist(), strict=True):
            phrase += [t[x : x + k] for x, k in zip(start[at : at + size].tolist(), (n[at : at + size] + LENGTH - 1).tolist(), strict=True)]
            at += size
        doc, rid = (np.repeat(s.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("doc", "rid"))
        c = np.fromiter(map(xxh3_64_intdigest, phrase), np.uint64, len(phrase)).view(np.int64)
        order = np.lexsort((doc, c))
        cut, _ = _runs(c[order])
        first = np.zeros(len(c), bool)
        first[order[cut]] = True
        return {"doc": doc, "rid": rid, "start": start, "n": n, "left": left, "h": h, "c": c, "low": doc, "phrase": [p if x else None for p, x in zip(phrase, first.tolist(), strict=True)]}

    return map_text(joined.select("doc", "rid", "text", "found"), PHRASE, run)


def _rows(b: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The lens bytes (LENGTH at most) of b from each place, filled up with zeros to whole words."""
    width = -(-LENGTH // 8) * 8
    out = np.concatenate([b, np.zeros(width, np.uint8)])[at[:, None] + np.arange(width)]
    out[np.arange(width) >= lens[:, None]] = 0
    return out


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers, whose order is that of the bytes."""
    return list(rows.view(">u8").astype(np.uint64).T)


def _tie_keys(padded: np.ndarray, at: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The suffixes of phrases from each place to the end of the trigger, as words filled up with zeros, and their lengths."""
    masks = ~np.uint64(0) << np.arange(64, 0, -8, dtype=np.uint64) % np.uint64(64)
    masks = np.array([0, *masks[1:], ~np.uint64(0)], np.uint64)
    words = [_word_at(padded, at + i) & masks[np.clip(before + WINDOW - i, 0, 8)] for i in range(0, LENGTH, 8)]
    return [*words, before]


def parse_ranks(follows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The suffix array of the parse up to the horizon, as the rank of what follows each phrase; equal ranks for equal ones."""
    keys = [*_words(follows), lens]
    order = np.lexsort(keys[::-1])
    cut, sizes = _runs(*(k[order] for k in keys))
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.repeat(np.arange(len(cut)), sizes)
    return rank


def corpus_order(phrases: list[bytes], left: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corpus order of the strings of phrases, trigger by trigger: (phrase number of each string, strings in
    order, where groups of equal ones begin). Strings are numbered phrase by phrase.

    phrases: with what follows up to the horizon; left: bytes before the trigger; h: the trigger's hash."""
    lens = np.array([len(p) for p in phrases], np.int64)
    b = np.frombuffer(b"".join(phrases), np.uint8)
    counts, begin = lens - LENGTH + 1, np.cumsum(lens) - lens
    which = np.repeat(np.arange(len(phrases)), counts)
    if not len(which):
        return which, which, which
    # The parse: from the trigger to the horizon of the phrase's last string.
    follows = _rows(b, begin + left, lens - left)
    rank = parse_ranks(follows, lens - left)[which]
    # The dictionary: the suffix of a string's phrase, up to the end of the trigger. The trigger and the first
    # bytes decide most of the order; the rest is compared where they are equal, and sorted where it differs.
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    before, at = left[which] - offset, begin[which] + offset
    padded = np.concatenate([b, np.zeros(64, np.uint8)])
    trigger = np.unique(h, return_inverse=True)[1].astype(np.uint64)
    bits = np.uint64(max(16, int(trigger.max()).bit_length()))
    key = trigger[which] << np.uint64(64) - bits | _word_at(padded, at) >> bits
    order = np.argsort(key, kind="stable")
    cut, sizes = _runs(key[order])
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    run = np.repeat(np.arange(len(cut)), sizes)[tied]
    keys = _tie_keys(padded, at[order[tied]], before[order[tied]])
    ranks = rank[order[tied]]
    inner = run[1:] == run[:-1]
    unlike = np.zeros(len(tied), bool)
    for k in (*keys, ranks):
        unlike[1:] |= inner & (k[1:] != k[:-1])
    mixed = np.zeros(len(cut), bool)
    mixed[run[unlike]] = True
    part = np.flatnonzero(mixed[run])
    to = np.arange(len(tied))
    to[part] = part[np.lexsort([ranks[part], *(k[part] for k in keys[::-1]), run[part]])]
    order[tied] = order[tied[to]]
    new = np.ones(len(order), bool)
    new[tied[1:][inner]] = False
    for k in keys:
        k = k[to]
        new[tied[1:]] |= k[1:] != k[:-1]
    # Equal suffixes: what follows has to agree for the rest of the string.
    same = np.flatnonzero(~new)
    same = same[rank[order[same]] != rank[order[same - 1]]]
    one, other = which[order[same]], which[order[same - 1]]
    rest = (LENGTH - before[order[same]])[:, None]
    new[same] = ((follows[one] != follows[other]) & (np.arange(follows.shape[1]) < rest)).any(axis=1)
    return which, order, np.flatnonzero(new)


def _smallest(dictionary: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(h, c, lowest, highest, mins): for each string of a phrase the smallest document that has it, mins,
    which is null where all are the same."""
    counts = keep(dictionary.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > SHARD_PHRASES).select("h", F.ceil(F.col("k") / SHARD_PHRASES).cast("int").alias("shards")))
    # The hot triggers have SHARD_PHRASES phrases each at least.
    dealt = dictionary.join(counts, "h", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("c"), F.col("shards")).cast("int")).repartition("h", "shard").sortWithinPartitions("h", "shard")
    schema_text = "h long, c long, merged boolean, lowest long, highest long, mins array<long>, digests array<binary>"
    schema = arrow_schema(schema_text)

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        phrases, doc = t.column("phrase").to_pylist(), t.column("low").to_numpy()
        which, order, groups = corpus_order(phrases, t.column("left").to_numpy().astype(np.int64), t.column("h").to_numpy())
        mins = np.zeros(len(which), np.int64)
        ranked = doc[which][order]
        mins[order] = np.repeat(np.minimum.reduceat(ranked, groups), np.diff(np.append(groups, len(order))))
        counts = np.array([len(p) for p in phrases]) - LENGTH + 1
        starts = np.cumsum(counts) - counts
        lowest, highest = np.minimum.reduceat(mins, starts), np.maximum.reduceat(mins, starts)
        hot = t.column("shards").to_numpy() > 1
        varied = hot | (lowest < highest)
        offsets = np.concatenate([[0], np.cumsum(np.where(varied, counts, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mins[np.repeat(varied, counts)]), mask=pa.array(~varied))
        digests = [[xxh3_128_digest(p[i : i + LENGTH]) for i in range(len(p) - LENGTH + 1)] if x else None for p, x in zip(phrases, hot.tolist(), strict=True)]
        return as_batch(schema, {"h": t.column("h").to_numpy(), "c": t.column("c").to_numpy(), "merged": ~hot, "lowest": lowest, "highest": highest, "mins": lists, "digests": digests})

    def run(batches):
        # Whole shards only, several at a time: different triggers have no strings in common.
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            h, shard = (b.column(c).to_numpy() for c in ("h", "shard"))
            cut, _ = _runs(h, shard)
            at = 0
            for x in cut.tolist():
                if (size + x - at > 20_000) and (x > 0 or last != (h[0], shard[0])):
                    held.append(b.slice(at, x - at))
                    if size + x - at:
                        yield solve([r for r in held if r.num_rows])
                    held, size, at = [], 0, x
            held.append(b.slice(at))
            size += b.num_rows - at
            last = h[-1], shard[-1]
        if size:
            yield solve([r for r in held if r.num_rows])

    solved = keep(dealt.select("h", "shard", "shards", "c", "phrase", "left", "low").mapInArrow(run, schema_text))
    names = ["h", "c", "lowest", "highest", "mins"]
    parts = keep(solved.where("not merged").select("h", "c", F.posexplode(F.arrays_zip("mins", "digests")).alias("i", "x")).select("h", "c", "i", F.col("x.mins").alias("m"), F.col("x.digests").alias("digest")))
    low = keep(parts.groupBy("digest").agg(F.min("m").alias("low")))
    hot = parts.join(low, "digest").groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("i", "low"))).alias("l"), F.min("low").alias("lowest"), F.max("low").alias("highest"))
    return solved.where("merged").select(names).unionByName(hot.select("h", "c", "lowest", "highest", F.col("l.low").alias("mins")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by LENGTH bytes from each start."""
    if not len(starts):
        return []
    s = np.unique(starts)
    new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + LENGTH]))
    return list(zip(s[new].tolist(), (s[np.append(new[1:] - 1, len(s) - 1)] + LENGTH).tolist(), strict=True))


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text (the
    bytes that stay) if asked for; as a stored table."""
    keyed = _keyed(docs)
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    some = keyed.where("text is not null")
    with releasing() as keep:
        copies = keep(_copies(some))
        repeated = materialize(_repeated(_trigger_rows(some, buckets), buckets))
        phrases = materialize(_phrases(some, repeated.join(copies, ["doc", "rid"], "left_anti")))
        release(repeated)
        dictionary = materialize(phrases.where("phrase is not null").groupBy("h", "c", "phrase").agg(F.min("low").alias("low"), F.min("left").alias("left")))
        mins = materialize(_smallest(dictionary, keep))
        release(dictionary)
        flagged = phrases.select("doc", "rid", "start", "n", "h", "c").join(mins, ["h", "c"]).where(F.col("lowest") < F.col("doc"))
        # Bit i: the string that starts i bytes on. A phrase has SPAN strings at most.
        some_bits = F.aggregate(F.transform("mins", lambda m, i: F.when(m < F.col("doc"), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.expr("0L"))), F.expr("0L"), lambda a, b: a + b)
        mask = F.when(F.col("highest") < F.col("doc"), F.pow(F.lit(2.0), F.col("n")).cast("long") - 1).otherwise(some_bits)
        found = keep(flagged.select("doc", "rid", (F.col("start") * (1 << SPAN) + mask).alias("x")).groupBy("doc", "rid").agg(F.collect_set("x").alias("found")))
        release(phrases, mins)
        joined = keyed.join(found, ["doc", "rid"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc", "rid"], "left")

        def run(s: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            for b, found, copy in zip(_bytes(s), s.column("found").to_pylist(), s.column("copy").to_pylist(), strict=True):
                x = np.array(found or [], np.int64)[:, None]
                bits = np.arange(SPAN)
                starts = ((x >> SPAN) + bits)[(x >> bits & 1).astype(bool)]
                kept, last, removed = hashlib.sha256(), 0, 0
                parts, spans = [], [(0, len(b))] if copy else _spans(starts)
                for a, e in spans:
                    parts.append(b[last:a])
                    removed, last = removed + e - a, e
                parts.append(b[last:])
                rest = b"".join(parts)
                kept.update(rest)
                for k, v in zip(out, (len(b), removed, len(spans), kept.hexdigest(), rest if with_text else None), strict=True):
                    out[k].append(v)
            return out | {"doc_id": s.column("doc_id")}

        result = map_text(joined.select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "text", "found", "copy"), RESULT, run)
        return materialize(result if with_text else result.drop("kept_text"))
