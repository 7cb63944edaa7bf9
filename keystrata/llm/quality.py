"""Quality classification by the perplexity of an interpolated modified Kneser-Ney trigram model.

The model of each language is trained on all trusted text: documents labelled good and not toxic, but for
those held out. Their n-grams are counted where they lie, and the counts are sharded by n-gram: the counts of
lower orders, the discounts, the totals of contexts and the back-off weights are aggregations and joins of
these tables, so no text reaches the driver. A finished model of SENT_ENTRIES n-grams at most is cut into
shards by the leading bits of the n-gram's hash and sent to all tasks, and documents are scored where they
lie: the n-grams of a slice of text are joined with the shards by binary search, unigrams first, and longer
ones only where their context is known.

A larger model is never stored. Every count and weight of a trigram and its bigram belongs to the trigram's
middle word, so trigrams are dealt by it, as packed blocks: a shard counts the trusted ones it gets and looks
up those of the documents beside them. A first exchange of the trusted text gives what spans shards, the
discounts and the words' probabilities, which are sent to all tasks. PASSES exchanges follow, each of the
trigrams whose middle word is of one residue, so that a fraction of them is on disk at a time. What a shard
gives is summed by the hash of language and text, over copies too, whose words count as often as their
probabilities. Both ways give the same perplexities.

A document is kept if its perplexity is at most the threshold of its language and length class: a
quantile of the perplexities of held-out trusted documents. One in HELD_OUT is held out by
a hash of its text, so that copies are on one side. A length class with fewer than LEAST_HELD_OUT of
them takes the quantile over all length classes of its language; documents trained on never count.

Edge cases: a null text, or one without words, has no perplexity and goes; documents of a language
without trusted or without held-out text have no threshold and stay; a null language is one of its own;
of rows that
repeat a doc_id one decides whether it is held out, and all are trained on if it is used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from keystrata.llm.common import arrow_schema, as_batch, lean, map_text, materialize, mix64, releasing, text_slices, words

#: N-grams and contexts of a model that is sent to all tasks, where each trusted word counts for five; larger ones are counted in shards.
SENT_ENTRIES = 1 << 22
#: Exchanges in which a large model's documents are scored.
PASSES = 4
#: Trusted text, and text to score, of a shard in the mean.
SHARD_TRUSTED, SHARD_SCORED = 1 << 23, 1 << 25
#: Trigrams that a task holds before it packs them.
BLOCK = 1 << 20
#: Trusted documents whose ids are sent to all tasks.
SENT_IDS = 1 << 22
QUANTILE, LEAST_HELD_OUT = 0.99, 20
#: One trusted document in HELD_OUT sets thresholds only.
HELD_OUT = 4
SHARD_BITS = 6
#: Upper bounds of the length classes, in words.
LENGTHS = (8, 32, 128, 512)
_ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_START = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Shards:
    """Values by 64-bit key: sorted keys, cut by their leading bits."""

    keys: list[np.ndarray]
    values: list[np.ndarray]

    @staticmethod
    def build(keys: np.ndarray, values: np.ndarray) -> Shards:
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(np.float32)
        cut = np.searchsorted(keys, np.arange(1, 1 << SHARD_BITS, dtype=np.uint64) << np.uint64(64 - SHARD_BITS))
        return Shards(np.split(keys, cut), np.split(values, cut))

    def join(self, keys: np.ndarray, default: float) -> np.ndarray:
        """The value of each key, or the default."""
        out = np.full(len(keys), default, np.float32)
        order = np.argsort(keys)
        ordered = keys[order]
        cut = np.searchsorted(ordered, np.arange(0, 1 << SHARD_BITS, dtype=np.uint64) << np.uint64(64 - SHARD_BITS))
        for s, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(keys)), strict=True)):
            have = self.keys[s]
            if a < b and len(have):
                at = np.minimum(np.searchsorted(have, ordered[a:b]), len(have) - 1)
                hit = have[at] == ordered[a:b]
                out[order[a:b][hit]] = self.values[s][at[hit]]
        return out


def discounts(n: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more; n: how many n-grams have the counts 1 to 4."""
    n = [0, *(max(1, int(x)) for x in n)]
    y = n[1] / (n[1] + 2 * n[2])
    return [0.0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), i - 0.01) for i in (1, 2, 3))]


def _context(lang: int, *ws: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(ws[0]), np.uint64(lang + 1) * _ORDER[0], np.uint64)
        for w in ws:
            h = mix64((h ^ w) * _ORDER[1] + _ORDER[2])
    return h


@dataclass(frozen=True)
class Model:
    languages: dict[str, int]
    unknown: np.ndarray
    #: Discounted probabilities of orders 1 to 3, and back-off weights of contexts of one and two words.
    alpha: tuple[Shards, Shards, Shards]
    gamma: tuple[Shards, Shards]

    def words(self, lang: int, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words w3 behind w2: the probability without context, whether the word is known, and the weight of
        w2 as a context, -1 where it is none."""
        p = self.alpha[0].join(_context(lang, w3), 0.0)
        known = p > 0
        return np.where(known, p, self.unknown[lang]), known, self.gamma[0].join(_context(lang, w2), -1.0)

    def log_probabilities(self, lang: int, seq: np.ndarray) -> np.ndarray:
        """ln p of each word after the first two, which are start marks or context."""
        w1, w2, w3 = seq[:-2], seq[1:-1], seq[2:]
        p, known, g = self.words(lang, w2, w3)
        has = np.flatnonzero(g >= 0)
        if len(has):
            a = np.zeros(len(has), np.float32)
            both = known[has]
            a[both] = self.alpha[1].join(_context(lang, w2[has][both], w3[has][both]), 0.0)
            p[has] = a + g[has] * p[has]
            g3 = self.gamma[1].join(_context(lang, w1[has], w2[has]), -1.0)
            deep = g3 >= 0
            at = has[deep]
            if len(at):
                p[at] = self.alpha[2].join(_context(lang, w1[at], w2[at], w3[at]), 0.0) + g3[deep] * p[at]
        return np.log(np.maximum(p, 1e-12))


@dataclass(frozen=True)
class Large:
    """What spans the shards of a model that is counted again from its texts."""

    texts: DataFrame
    languages: dict[str, int]
    #: By language: discounts of orders 2 and 3.
    less: np.ndarray
    unknown: np.ndarray
    words: Shards


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))


NGRAM = "lang string, a long, b long, c long, n long"
ENTRY = "kind int, key long, value double"
_MARK = int(_START) - (1 << 64) if int(_START) >> 63 else int(_START)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(lang, a, b, c, n) of the hashed trigrams of rows (lang, text), with two start marks before each text."""
    schema = arrow_schema(NGRAM)

    def count(batches):
        for b in batches:
            for s in text_slices(b):
                langs, lists = np.array(s.column("lang").to_pylist(), object), [words(t) for t in s.column("text").to_pylist()]
                for lang in sorted(set(langs)):
                    parts = [np.concatenate([[_START, _START], hashed(ws)]) for x, ws in zip(langs, lists, strict=True) if x == lang and ws]
                    if not parts:
                        continue
                    seq = np.concatenate(parts)
                    ok = np.concatenate([np.arange(len(p)) >= 2 for p in parts])
                    tri, n = np.unique(np.stack([np.roll(seq, 2), np.roll(seq, 1), seq])[:, ok], axis=1, return_counts=True)
                    a, b_, c = tri.view(np.int64)
                    yield as_batch(schema, {"lang": [lang] * len(n), "a": a, "b": b_, "c": c, "n": n})

    return texts.mapInArrow(count, NGRAM).groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """The counts n with their discounted share p of the context's total; and each context's total and back-off weight g."""
    per = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).collect()  # a row a language
    d = F.lit(0.0)
    for r in per:
        _, d1, d2, d3 = discounts([r[f"n{i}"] for i in range(1, 5)])
        d = F.when(F.col("lang") == r["lang"], F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(d)
    less = counts.withColumn("d", d)
    totals = less.groupBy("lang", *context).agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"))
    return less.join(totals, ["lang", *context]).withColumn("p", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")), totals


def fit(texts: DataFrame) -> Model | Large:
    """Models of the languages of rows (lang, text)."""
    if 5 * _words_of(texts) > SENT_ENTRIES:
        return _fit_large(texts)
    with releasing() as keep:
        tri = keep(ngram_counts(texts))
        # Lower orders count the different words before, but behind a start mark the n-grams themselves.
        two = keep(tri.groupBy("lang", "b", "c").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).select("lang", "b", "c", F.when(F.col("b") == _MARK, F.col("all")).otherwise(F.col("kinds")).alias("n")))
        one = keep(two.groupBy("lang", "c").agg(F.count("*").alias("n")))
        (p1, t1), (p2, t2), (p3, t3) = _discounted(one, []), _discounted(two, ["b"]), _discounted(tri, ["a", "b"])
        left = {r["lang"]: (r["g"], r["size"]) for r in t1.join(one.groupBy("lang").agg(F.count("*").alias("size")), "lang").collect()}
        languages = {lang: n for n, lang in enumerate(sorted(left))}
        # What the unigrams leave is shared evenly by all words of the language and one unknown word.
        unknown = np.array([left[lang][0] / (left[lang][1] + 1) for lang in languages])
        schema, no = arrow_schema(ENTRY), F.lit(None).cast("long")
        rows = p1.select("lang", no.alias("a"), no.alias("b"), "c", F.col("p").alias("value"), F.lit(0).alias("kind"))
        for frame, kind, value in ((p2, 1, "p"), (p3, 2, "p"), (t2, 3, "g"), (t3, 4, "g")):
            rows = rows.unionByName(frame.withColumns({"value": F.col(value), "kind": F.lit(kind)}), allowMissingColumns=True).select("lang", "a", "b", "c", "value", "kind")

        def key(batches):
            for batch in batches:
                kinds, langs = batch.column("kind").to_numpy(), np.array([languages[x] for x in batch.column("lang").to_pylist()], np.int64)
                word = {w: pc.fill_null(batch.column(w), 0).to_numpy(zero_copy_only=False).view(np.uint64) for w in "abc"}
                value = batch.column("value").to_numpy().copy()
                value[kinds == 0] += unknown[langs[kinds == 0]]
                keys = np.zeros(batch.num_rows, np.uint64)
                for k, used in enumerate(("c", "bc", "abc", "b", "ab")):
                    for lang in np.unique(langs[kinds == k]):
                        at = np.flatnonzero((kinds == k) & (langs == lang))
                        keys[at] = _context(int(lang), *(word[w][at] for w in used))
                yield as_batch(schema, {"kind": kinds, "key": keys.view(np.int64), "value": value})

        entries = rows.mapInArrow(key, ENTRY).toArrow()
    kinds, keys, values = entries.column("kind").to_numpy(), entries.column("key").to_numpy().view(np.uint64), entries.column("value").to_numpy()
    shards = [Shards.build(keys[kinds == k], values[kinds == k]) for k in range(5)]
    return Model(languages, unknown, tuple(shards[:3]), tuple(shards[3:]))


# -- models too large to send ---------------------------------------------------------------------


#: A-Z lower-cased, ASCII white space as blanks.
_LOWER = np.frombuffer(bytes(32 if chr(i) in " \t\n\r\x0b\x0c" else i + 32 * (65 <= i <= 90) for i in range(256)), np.uint8)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts with _LOWER, where their words() begin and end there, and how many each text has."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, wide, len(texts) + 1, np.dtype(wide).itemsize * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = raw != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return raw, start, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(start, bounds))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words() of texts, one after the other, and how many each text has. Words of one
    length up to eight bytes never meet."""
    raw, start, end, counts = _split(texts)
    size, held = end - start, np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64(size.astype(np.uint64) * _ORDER[0] + _ORDER[2])
        rest = np.arange(len(h))
        for k in range(0, 64, 8):
            left = size[rest] - k
            h[rest] = mix64(h[rest] ^ (eight[start[rest] + k] << (64 - 8 * np.minimum(left, 8)).astype(np.uint64)))
            rest = rest[left > 8]
            if not len(rest):
                break
    for i in rest:
        h[i] = xxh3_64_intdigest(held[start[i] : start[i] + size[i]].tobytes())
    return h, counts


def _words_of(texts: DataFrame) -> int:
    """How many words the texts have."""
    counted = map_text(texts.select("text"), "n long", lambda s: {"n": [len(_split(s.column("text"))[1])]})
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers: of those under 2 ** 32 the bytes of equal weight lie together."""
    out = [np.array([len(arrays), *map(len, arrays), *(x.itemsize for x in arrays)], np.int64).tobytes()]
    out += [x.tobytes() if x.itemsize == 8 else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * k, 8)
    at, out = 8 + 16 * k, []
    for n, width in zip(head[:k].tolist(), head[k:].tolist(), strict=True):
        part = np.frombuffer(raw, np.uint8, n * width, at)
        out.append(part.view(np.uint64) if width == 8 else np.ascontiguousarray(part.reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


def _narrow(x: np.ndarray, most: int) -> np.ndarray:
    return x.astype(np.uint16 if most <= 1 << 16 else np.uint32)


def _block(a: np.ndarray, b: np.ndarray, c: np.ndarray, key: np.ndarray | None) -> bytes:
    """Trigrams as numbers in the list of their words, the frequent ones first; by text, if keys of texts are given."""
    ws, at, n = np.unique(np.concatenate([a, b, c]), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(ws), np.int64)
    place[order] = np.arange(len(ws))
    x, y, z = _narrow(place[at], len(ws)).reshape(3, -1)
    if key is None:
        by = np.argsort(y, kind="stable")
        return _packed([ws[order], x[by], y[by], z[by]])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return _packed([ws[order], x, y, z, key[first], np.diff(np.append(first, len(key))).astype(np.uint32)])


BLOCKS = "shard int, lang int, scored boolean, data binary"


def _blocks(frame: DataFrame, languages: dict[str, int], shards: int, passes: int, turn: int, scored: bool) -> DataFrame:
    """The trigrams of rows (lang, text) whose middle word belongs to this turn, as packed blocks for each shard."""
    schema = arrow_schema(BLOCKS)

    def run(batches):
        held: dict[int, list] = {}

        def pack(lang: int) -> pa.RecordBatch:
            shard, *arrays = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            which, at = np.unique(shard[order], return_index=True)
            parts = [_block(*(x[i] for x in arrays[:3]), arrays[3][i] if scored else None) for i in np.split(order, at[1:])]
            return as_batch(schema, {"shard": which, "lang": [lang] * len(which), "scored": [scored] * len(which), "data": parts})

        for batch in batches:
            for s in text_slices(batch):
                h, sizes = word_hashes(s.column("text"))
                texts, langs = s.column("text"), s.column("lang").to_pylist()
                number = np.array([languages.get(x, -1) for x in langs], np.int64)
                keys = np.zeros(len(langs), np.uint64)
                if scored:
                    keys = text_keys(langs, texts)
                keep = np.repeat(number >= 0, sizes)
                some = (number >= 0) & (sizes > 0)
                h, number, keys, sizes = h[keep], number[some], keys[some], sizes[some]
                if not len(h):
                    continue
                own = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(2, len(h) + 2) + 2 * own
                seq = np.full(len(h) + 2 * len(sizes), _START, np.uint64)
                seq[at] = h
                middle = seq[at - 1]
                shard = ((mix64(middle ^ _ORDER[1]) >> np.uint64(24)) % np.uint64(shards * passes)).astype(np.int64)
                here = np.flatnonzero(shard % passes == turn)
                for lang in np.unique(number):
                    i = here[number[own[here]] == lang]
                    if len(i):
                        held.setdefault(int(lang), []).append((shard[i] // passes, seq[at[i] - 2], middle[i], h[i], keys[own[i]]))
                        if sum(len(x[0]) for x in held[int(lang)]) >= BLOCK:
                            yield pack(int(lang))
        for lang in list(held):
            yield pack(lang)

    return frame.select("lang", "text").mapInArrow(lean(run), BLOCKS)


def text_keys(langs: list[str], texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxh3_64_intdigest(t or "", xxh3_64_intdigest(x)) for x, t in zip(langs, texts.to_pylist(), strict=True)), np.uint64, len(langs))


def _found(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of keys among the sorted ones we have, -1 where there is none."""
    if not len(have):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, at, -1)


class Trigrams:
    """The counts of a shard's trusted trigrams, all those of its middle words."""

    def __init__(self, blocks: list[list[np.ndarray]]):
        self.words, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in blocks)]), return_inverse=True)
        self.size = len(self.words)
        cuts, grams = np.cumsum([0, *(len(x[0]) for x in blocks)]), []
        for k in (1, 2, 3):
            grams.append(np.concatenate([np.zeros(0, np.int64), *(at[i:j][x[k]] for i, j, x in zip(cuts, cuts[1:], blocks, strict=False))]))
        a, b, c = grams
        self.pairs, at = np.unique(a * self.size + b, return_inverse=True)
        self.grams, self.n3 = np.unique(at * self.size + c, return_counts=True)
        self.pair, c = np.divmod(self.grams, max(1, self.size))
        b = self.pairs[self.pair] % max(1, self.size)
        self.twos, at = np.unique(b * self.size + c, return_inverse=True)
        # Behind a start mark the n-grams themselves count, elsewhere the different words before.
        self.n2 = np.bincount(at, np.where(self.words[b] == _START, self.n3, 1), len(self.twos)).astype(np.int64)
        self.first, self.second = np.divmod(self.twos, max(1, self.size))

    def weigh(self, less: np.ndarray) -> None:
        """Discounted probabilities and weights of contexts; less: the discounts of orders 2 and 3 for 0 to 3 and more."""
        for order, n, of, size in ((2, self.n2, self.first, self.size), (3, self.n3, self.pair, len(self.pairs))):
            d = less[order - 2][np.minimum(n, 3)]
            total = np.bincount(of, n, size)
            with np.errstate(invalid="ignore"):
                g = np.where(total > 0, np.bincount(of, d, size) / total, -1.0)
            setattr(self, f"p{order}", np.maximum(n - d, 0.0) / total[of])
            setattr(self, f"g{order}", g)

    def score(self, block: list[np.ndarray], p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text of a block: its key, words here, and the sum of their ln p; p1: of the block's words."""
        ws, a, b, c, keys, sizes = block
        known = _found(self.words, ws)
        p = p1[c]
        a, b, c = known[a], known[b], known[c]
        has = np.flatnonzero(b >= 0)
        has = has[self.g2[b[has]] >= 0]
        if len(has):
            a, b, c = a[has], b[has], c[has]
            two = np.where(c >= 0, _found(self.twos, b * self.size + c), -1)
            q = np.where(two >= 0, self.p2[two], 0.0) + self.g2[b] * p[has]
            pair = np.where(a >= 0, _found(self.pairs, a * self.size + b), -1)
            deep = np.flatnonzero(pair >= 0)
            if len(deep):
                pair, c = pair[deep], c[deep]
                gram = np.where(c >= 0, _found(self.grams, pair * self.size + c), -1)
                q[deep] = np.where(gram >= 0, self.p3[gram], 0.0) + self.g3[pair] * q[deep]
            p[has] = q
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]])
        return keys, sizes.astype(np.int64), np.add.reduceat(np.log(np.maximum(p, 1e-12)), ends)


def _dealt(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "scored")


def _groups(batches):
    """(shard and lang, scored, blocks) of a stream in the order of _dealt, the blocks as an iterator to be read to its end."""
    rows = ((row, lang, scored, data) for batch in batches for row, lang, scored, data in zip(*(batch.column(x).to_pylist() for x in ("shard", "lang", "scored", "data")), strict=True))
    for (shard, lang, scored), held in groupby(rows, key=lambda x: x[:3]):
        yield (shard, lang), scored, (_unpacked(x[3]) for x in held)


def _shards(*sizes: tuple[DataFrame, int]) -> int:
    """Shards of one exchange, for the text of frames and the bytes of it that a shard gets. They grow with the
    text alone, as each one that a text's words are dealt to gives a row for it."""
    most = [(f.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] or 0) // n + 1 for f, n in sizes]
    return max(2 * sizes[0][0].sparkSession.sparkContext.defaultParallelism, *most)


def _fit_large(texts: DataFrame) -> Large:
    languages = {lang: n for n, lang in enumerate(sorted(r["lang"] for r in texts.select("lang").distinct().collect()))}
    schema, shards = arrow_schema("lang int, level int, key long, n long"), _shards((texts, SHARD_TRUSTED))

    def count(batches):
        """Before how many words a word has another (level 1); how many n-grams of the level have a count of 1 to 4."""
        for (_, lang), _, blocks in _groups(batches):
            t = Trigrams(list(blocks))
            at, n = np.unique(t.second, return_counts=True)
            levels, keys, ns = [np.ones(len(at), np.int64)], [t.words[at].view(np.int64)], [n]
            for level, counts in ((2, t.n2), (3, t.n3)):
                levels.append(np.full(4, level))
                keys.append(np.arange(1, 5))
                ns.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])
            levels, keys, ns = map(np.concatenate, (levels, keys, ns))
            yield as_batch(schema, {"lang": np.full(len(ns), lang), "level": levels, "key": keys, "n": ns})

    counted = _dealt(_blocks(texts, languages, shards, 1, 0, False), shards).mapInArrow(lean(count), "lang int, level int, key long, n long")
    with releasing() as keep:
        found = keep(counted.groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))).toArrow()
    langs, levels, keys, n = (found.column(x).to_numpy() for x in ("lang", "level", "key", "n"))
    less, unknown, all_keys, all_p = np.zeros((len(languages), 2, 4)), np.zeros(len(languages)), [], []
    for lang in range(len(languages)):
        for level in (2, 3):
            at = (langs == lang) & (levels == level)
            of = dict(zip(keys[at].tolist(), n[at].tolist(), strict=True))
            less[lang, level - 2] = discounts([of.get(i, 0) for i in range(1, 5)])
        at = np.flatnonzero((langs == lang) & (levels == 1))
        if not len(at):
            continue
        ones = n[at]
        d = np.array(discounts([int(np.count_nonzero(ones == i)) for i in range(1, 5)]))[np.minimum(ones, 3)]
        # What the unigrams leave is shared evenly by all words of the language and one unknown word.
        unknown[lang] = d.sum() / ones.sum() / (len(at) + 1)
        all_keys.append(_context(lang, keys[at].view(np.uint64)))
        all_p.append(np.maximum(ones - d, 0.0) / ones.sum() + unknown[lang])
    ones = Shards.build(np.concatenate([np.zeros(0, np.uint64), *all_keys]), np.concatenate([np.zeros(0), *all_p]))
    return Large(texts, {x: i for x, i in languages.items() if unknown[i] > 0}, less, unknown, ones)


SUMS = "key long, n long, log_p double"


def _summed(docs: DataFrame, large: Large) -> DataFrame:
    """perplexities() of a large model, as a stored table."""
    schema, spark = arrow_schema(SUMS), docs.sparkSession
    less, unknown, held = large.less, large.unknown, spark.sparkContext.broadcast(large.words)
    shards = _shards((large.texts, PASSES * SHARD_TRUSTED), (docs, PASSES * SHARD_SCORED))

    def score(batches):
        t, of = None, None
        for own, scored, blocks in _groups(batches):
            lang = own[1]
            if not scored or own != of:
                t, of = Trigrams([] if scored else list(blocks)), own
                t.weigh(less[lang])
            if not scored:
                continue
            for block in blocks:
                p1 = held.value.join(_context(lang, block[0]), 0.0).astype(float)
                keys, n, log_p = t.score(block, np.where(p1 > 0, p1, unknown[lang]))
                yield as_batch(schema, {"key": keys.view(np.int64), "n": n, "log_p": log_p})

    def count(s: pa.RecordBatch) -> dict:
        langs = s.column("lang").to_pylist()
        return {"doc_id": s.column("doc_id"), "lang": langs, "n_words": word_hashes(s.column("text"))[1], "key": text_keys(langs, s.column("text")).view(np.int64)}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    total = lambda f: f.groupBy("key").agg(F.sum("n").alias("n"), F.sum("log_p").alias("log_p"))
    with releasing() as keep:
        sums = None
        for turn in range(PASSES):
            parts = [_blocks(f, large.languages, shards, PASSES, turn, scored) for f, scored in ((large.texts, False), (docs, True))]
            now = keep(total(_dealt(parts[0].unionByName(parts[1]), shards).mapInArrow(lean(score), SUMS)))
            sums = now if sums is None else sums.unionByName(now)
        counted = map_text(docs, "doc_id long, lang string, n_words long, key long", count)
        value = F.when(F.col("n_words") > 0, F.exp(-F.col("log_p") / F.col("n")))
        return materialize(counted.join(total(sums), "key", "left").select("doc_id", "lang", "n_words", value.alias("perplexity")))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model | Large, DataFrame]:
    """The model, and the stored table (doc_id, held_out, used) of trusted documents: those held out are
    never used, all others are."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    first = F.min(F.struct("lang", "held_out"))
    sized = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), (F.pmod(F.xxhash64("text", F.lit(31)), F.lit(HELD_OUT)) == 0).alias("held_out"))
    marked = materialize(sized.join(good, "doc_id").groupBy("doc_id").agg(first.alias("x")).select("doc_id", "x.held_out", (~F.col("x.held_out")).alias("used")))
    ids = marked.where("used").select("doc_id")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).where("text is not null")
    few = ids.count() <= SENT_IDS  # more are joined by an exchange of the texts
    return fit(drawn.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("lang", "text")), marked


def perplexities(docs: DataFrame, model: Model | Large) -> DataFrame:
    """(doc_id, lang, n_words, perplexity): perplexity is null without words or without a model."""
    if isinstance(model, Large):
        return _summed(docs, model)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SENT_ENTRIES at most
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def run(s: pa.RecordBatch) -> dict:
        m, langs = held.value, s.column("lang").to_pylist()
        lists = [words(t) for t in s.column("text").to_pylist()]
        out: list = [None] * len(lists)
        for lang in sorted(set(langs) & set(m.languages)):
            mine = [i for i, x in enumerate(langs) if x == lang and lists[i]]
            if not mine:
                continue
            seq = np.concatenate([np.concatenate([[_START, _START], hashed(lists[i])]) for i in mine])
            log_p = m.log_probabilities(m.languages[lang], seq)
            sizes = np.array([len(lists[i]) for i in mine])
            starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
            sums = np.concatenate([[0.0], np.cumsum(log_p, dtype=np.float64)])
            for i, a, n in zip(mine, starts, sizes, strict=True):
                out[i] = float(np.exp(-(sums[a + n] - sums[a]) / n))
        return {"doc_id": s.column("doc_id"), "lang": langs, "n_words": [len(x) for x in lists], "perplexity": out}

    return map_text(src, "doc_id long, lang string, n_words long, perplexity double", run)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per document: doc_id, lang, n_words, perplexity, threshold, kept; as a stored table."""
    with releasing() as keep:
        return materialize(_classify(docs, labels, quantile, keep))


def _classify(docs: DataFrame, labels: DataFrame, quantile: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    model, trusted = train(docs, labels)
    keep(trusted)
    scored = keep(perplexities(docs, model))
    length = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        length = F.when(F.col("n_words") <= LENGTHS[i], i).otherwise(length)
    scored = scored.withColumn("length", length)
    found = keep(scored.join(trusted.where("held_out"), "doc_id").where("perplexity is not null").select("lang", "length", "perplexity"))
    limit = F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY perplexity)")
    own = found.groupBy("lang", "length").agg(F.count("*").alias("n"), limit.alias("own")).where(F.col("n") >= LEAST_HELD_OUT).drop("n")
    pooled = found.groupBy("lang").agg(limit.alias("pooled"))
    lengths = docs.sparkSession.range(len(LENGTHS) + 1).select(F.col("id").cast("int").alias("length"))
    limits = pooled.crossJoin(lengths).join(own, ["lang", "length"], "left").select("lang", "length", F.coalesce("own", "pooled").alias("threshold"))
    limits = keep(limits)  # a row per language and length class
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    joined = scored.join(limits, ["lang", "length"], "left")
    return joined.select("doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "n_words", "perplexity", "threshold", kept.alias("kept"))
