"""Document scores by masked pseudo-likelihood under a bidirectional window network, trained in numpy.

The network predicts every token from its neighbours on both sides: each side has its own table of hidden
vectors, their sum goes through tanh, and a softmax layer gives the token's distribution. A document's score
is the sum of the log-probabilities of its tokens, each given both sides.

A token's probability is p(class | both neighbours) p(word | class). The network gives the class: the most
frequent words of the whole corpus have one each, the others fall into classes by a hash of their ending.
Within a class a word's probability comes from the counts of all words over all documents, without the
masked token itself and less DISCOUNT; what is taken off is the share of new words. A word that the corpus has
nowhere else is spelled: its probability is that share times those of its letters, each given the one before,
by the counts over all distinct words. A word that the corpus has RARE times at most also depends on the words
next to it: where the corpus has rare words of its class between the same two words elsewhere, half of the
probability is shared by those. The counts of the CACHED most frequent words, of more than RARE tokens each,
are sent to all tasks; the other words' tokens are counted by word, and the rare ones by their neighbours,
where they meet.

The network is trained on all tokens of all documents. The window of a token is three classes, so the
corpus enters as the number of times that each window occurs: whole numbers, counted side by side and added
up, the same however the rows are dealt. They are CLASSES^3 at most, and training draws contexts from them
as often as they occur, with the distribution of the tokens that were seen there.

Edge cases: a null text, or one without words, has no tokens, log-likelihood 0 and no score; a text's first
and last word have a boundary token as their neighbour; equal texts get equal scores, and each counts;
without any word the network is uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from keystrata.llm.common import arrow_schema, as_batch, grouped, map_text, materialize, mix64, release, releasing, text_slices, words

FREQUENT, ENDINGS = 191, 64
CLASSES = 1 + FREQUENT + ENDINGS
HIDDEN, SIDE = 32, 1
#: Steps of training, contexts in a step, and the step size of the first; it falls to 0.
STEPS, BATCH, RATE = 1500, 1024, 0.02
COUNTED = 200_000
#: Blocks that the counts of windows are cut into, and groups of tasks that are added up first.
BLOCKS, GROUPS = 64, 16
#: Words at most whose counts are sent to all tasks, and tokens at most of a rare word.
CACHED, RARE = 1 << 17, 64
DISCOUNT, SHARED = 0.5, 0.5


def ending(word: bytes) -> int:
    return xxh3_64_intdigest(word[-3:]) % ENDINGS


def counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of every word of all documents."""
    schema = arrow_schema("word binary, ending int, n long")

    def rows(seen: Counter) -> pa.RecordBatch:
        return as_batch(schema, {"word": list(seen), "ending": list(map(ending, seen)), "n": list(seen.values())})

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for s in text_slices(b):
                for t in s.column("text").to_pylist():
                    seen.update(words(t))
                if len(seen) > COUNTED:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    parts = docs.select("text").mapInArrow(count, "word binary, ending int, n long")
    return parts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def vocabulary(table: DataFrame) -> list[bytes]:
    """The most frequent words of a table of counts; equal counts in the words' order."""
    return [bytes(r["word"]) for r in table.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def cached(table: DataFrame) -> list:
    """(word, ending, n) of the most frequent words: all those of the largest counts above RARE, CACHED at most."""
    table = table.where(F.col("n") > RARE)
    size = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for r in sorted(table.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        held += r["count"]
        if held > CACHED:
            break
        least = r["size"]
    return table.where(size >= least).collect() if least is not None else []


def letters(table: DataFrame) -> np.ndarray:
    """ln p(letter | the one before) of the bytes of all words of a table of counts; a space stands for either
    end. Pairs of bytes reach the driver."""
    schema = arrow_schema("code int, n long")

    def pairs(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b" " + b" ".join(b.column("word").to_pylist()) + b" ", np.uint8).astype(np.int64)
                total += np.bincount(x[:-1] << 8 | x[1:], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield as_batch(schema, {"code": at, "n": total[at]})

    seen = np.full(1 << 16, 0.5)
    for r in table.select("word").mapInArrow(pairs, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        seen[r["code"]] += r["n"]
    seen = seen.reshape(256, 256)
    return np.log(seen / seen.sum(axis=1, keepdims=True)).ravel()


def spelled(ws: list[bytes], letter: np.ndarray) -> np.ndarray:
    """ln p of each word, letter by letter to its end."""
    if not ws:
        return np.zeros(0)
    x = np.frombuffer(b" " + b" ".join(ws) + b" ", np.uint8).astype(np.int64)
    starts = np.cumsum([0, *(len(w) + 1 for w in ws[:-1])])
    return np.add.reduceat(letter[x[:-1] << 8 | x[1:]], starts)


class Classes(dict):
    """Word -> class; 0 is the boundary. Rare words are looked up by their ending and not kept."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__((w, i + 1) for i, w in enumerate(frequent))

    def __missing__(self, word: bytes) -> int:
        return 1 + FREQUENT + ending(word)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts, with SIDE boundaries around each; and each text's tokens."""
        lists = [words(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        pad, out = [0] * SIDE, []
        for x in lists:
            out += pad
            out += map(self.__getitem__, x)
            out += pad
        return np.array(out, np.int64), sizes


class Words(dict):
    """Word -> number of the cached words; others are numbered behind them as they come, until forget()."""

    def __init__(self, frequent: list[bytes], known: list[tuple[bytes, int]], totals: np.ndarray, types: np.ndarray, letter: np.ndarray) -> None:
        """known: words with their counts. totals, types: tokens and distinct words by ending, without the frequent words."""
        super().__init__((w, i) for i, (w, _) in enumerate(known))
        self.classes, self.size, self.others, self.letter = Classes(frequent), len(known), [], letter
        self.cls = np.array([self.classes[w] for w, _ in known], np.int64)
        self.log_total = np.concatenate([np.zeros(1 + FREQUENT), np.log(np.maximum(totals, 1))])
        self.log_new = np.log(DISCOUNT * np.maximum(types, 1))
        n = np.array([n for _, n in known], np.float64) - 1
        self.log_n = np.where(self.cls <= FREQUENT, 0.0, np.where(n > 0, np.log(np.maximum(n - DISCOUNT, DISCOUNT)), self.new([w for w, _ in known], self.cls)))

    def new(self, ws: list[bytes], cls: np.ndarray) -> np.ndarray:
        """What stands for ln(n - 1 - DISCOUNT) where a word's own token is its only one."""
        return self.log_new[np.maximum(cls - 1 - FREQUENT, 0)] + spelled(ws, self.letter)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = self.size + len(self.others)
        self.others.append(word)
        return i

    def forget(self) -> None:
        for w in self.others:
            del self[w]
        self.others = []


class Network:
    """tables (2, CLASSES, HIDDEN) for the left and right neighbour, out (HIDDEN, CLASSES), bias (CLASSES)."""

    SIZES = (2 * CLASSES * HIDDEN, HIDDEN * CLASSES, CLASSES)

    def __init__(self, flat: np.ndarray | None = None) -> None:
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([rng.normal(0, 0.1, sum(self.SIZES[:2])), np.zeros(CLASSES)])
        self.flat = flat.astype(np.float32)
        tables, out, self.bias = np.split(self.flat, np.cumsum(self.SIZES)[:2])
        self.tables, self.out = tables.reshape(2, CLASSES, HIDDEN), out.reshape(HIDDEN, CLASSES)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: left * CLASSES + right."""
        return np.tanh(self.tables[0][context // CLASSES] + self.tables[1][context % CLASSES])

    def log_table(self) -> np.ndarray:
        """ln p(class | context) of all contexts, one row each."""
        out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
        for at in range(0, len(out), 8192):
            z = self.hidden(np.arange(at, min(at + 8192, len(out)))) @ self.out + self.bias
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 8192] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean cross-entropy between the targets' distributions and the network's, laid out as flat."""
        h = self.hidden(context)
        p = h @ self.out + self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p -= target
        p /= np.float32(len(context))
        back = (p @ self.out.T) * (1 - h * h)
        grad = np.zeros_like(self.flat)
        tables = grad[: self.SIZES[0]].reshape(2, CLASSES, HIDDEN)
        np.add.at(tables[0], context // CLASSES, back)
        np.add.at(tables[1], context % CLASSES, back)
        grad[self.SIZES[0] : -CLASSES] = (h.T @ p).ravel()
        grad[-CLASSES:] = p.sum(axis=0)
        return grad


def _places(sizes: np.ndarray) -> np.ndarray:
    """Where the tokens are in padded texts."""
    return np.arange(int(sizes.sum())) + np.repeat(SIDE * (2 * np.arange(len(sizes)) + 1), sizes)


def windows(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of each place's window: (left, right, own)."""
    return (tokens[at - 1] * CLASSES + tokens[at + 1]) * CLASSES + tokens[at]


PART = "block int, grp int, code binary, n binary"


def _added(batches, keys: list[str], schema: pa.Schema):
    """One row for each group of PART rows: the sum of its counts."""
    width = -(-(CLASSES**3) // BLOCKS)
    for g in grouped(batches, keys):
        block, total = g.column("block")[0].as_py(), np.zeros(width, np.int64)
        for code, n in zip(g.column("code").to_pylist(), g.column("n").to_pylist(), strict=True):
            total[np.frombuffer(code, np.uint32)] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(total)
        yield as_batch(schema, {"block": [block], "grp": [g.column("grp")[0].as_py()], "code": [at.astype(np.uint32).tobytes()], "n": [total[at].tobytes()]})


def window_counts(docs: DataFrame, frequent: list[bytes]) -> DataFrame:
    """(block, grp, code, n): how often each window occurs in all documents, packed by block of windows; a
    code is the window's place in its block. A task counts its rows in one array."""
    schema, classes, width = arrow_schema(PART), Classes(frequent), -(-(CLASSES**3) // BLOCKS)

    def count(batches):
        total, seen = np.zeros(BLOCKS * width, np.uint32), 0

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            cut = np.searchsorted(at, np.arange(BLOCKS + 1) * width)
            full = [b for b in range(BLOCKS) if cut[b] < cut[b + 1]]
            codes = [(at[cut[b] : cut[b + 1]] - b * width).astype(np.uint32).tobytes() for b in full]
            ns = [total[at[cut[b] : cut[b + 1]]].astype(np.int64).tobytes() for b in full]
            return as_batch(schema, {"block": full, "grp": [0] * len(full), "code": codes, "n": ns})

        for b in batches:
            for s in text_slices(b):
                tokens, sizes = classes.encode(s.column("text").to_pylist())
                code, n = np.unique(windows(tokens, _places(sizes)), return_counts=True)
                total[code] += n.astype(np.uint32)
                seen += int(sizes.sum())
                if seen > 1 << 31:
                    yield rows()
                    total[:], seen = 0, 0
        yield rows()

    parts = docs.select("text").mapInArrow(count, PART).withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    by = ["block", "grp"]
    some = parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _added(b, by, schema), PART)
    return some.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _added(b, ["block"], schema), PART)


def dense(table: DataFrame) -> np.ndarray:
    """The counts as an array (contexts, classes); a row for each block reaches the driver."""
    width = -(-(CLASSES**3) // BLOCKS)
    out = np.zeros(BLOCKS * width, np.float32)
    for r in table.select("block", "code", "n").toLocalIterator():
        out[r["block"] * width + np.frombuffer(bytes(r["code"]), np.uint32).astype(np.int64)] = np.frombuffer(bytes(r["n"]), np.int64)
    return out[: CLASSES**3].reshape(-1, CLASSES)


def fit(counts: np.ndarray, steps: int = STEPS) -> Network:
    """Trains on counts (contexts, classes): each step draws contexts as often as they occur (Adam)."""
    of_context = counts.sum(axis=1, dtype=np.float64)
    total = of_context.sum()
    if not total:
        return Network(np.zeros(sum(Network.SIZES)))
    net, rng = Network(), np.random.default_rng(12)
    net.bias[:] = np.log((counts.sum(axis=0, dtype=np.float64) + 0.5) / (total + 0.5 * CLASSES))
    up = np.cumsum(of_context) / total
    m, v = np.zeros_like(net.flat), np.zeros_like(net.flat)
    for t in range(1, steps + 1):
        context = np.minimum(np.searchsorted(up, rng.random(BATCH), "right"), len(up) - 1)
        context = context[of_context[context] > 0]
        g = net.gradient(context, counts[context] / of_context[context, None].astype(np.float32))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        net.flat -= np.float32(RATE * (1 - (t - 1) / steps)) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return net


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, score (the mean log-probability of a token), log_likelihood (their sum), n_tokens;
    as a stored table."""
    with releasing() as keep:
        return materialize(_score(docs, keep))


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))


def _score(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    table = keep(counts(docs))
    frequent = vocabulary(table)
    known = [(bytes(r["word"]), r["n"]) for r in cached(table)]
    totals, types, rare = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(ENDINGS)
    by_ending = table.where(~F.col("word").isin(frequent)).groupBy("ending")
    for r in by_ending.agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.sum(F.when(F.col("n") <= RARE, F.col("n")).otherwise(0)).alias("rare")).collect():
        totals[r["ending"]], types[r["ending"]], rare[r["ending"]] = r["n"], r["types"], r["rare"]
    seen = materialize(window_counts(docs, frequent))
    net = fit(dense(seen))
    release(seen)
    held = docs.sparkSession.sparkContext.broadcast((net.flat, frequent, known, totals, types, letters(table)))  # bounded by CACHED
    made: list = []

    def run(s: pa.RecordBatch) -> dict:
        if not made:
            words_ = Words(*held.value[1:])
            made.extend([words_, Network(held.value[0]).log_table().ravel(), _hashes(list(words_))])
        vocab, of_window, hash_known = made
        lists = [words(t) for t in s.column("text").to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        n, places = int(sizes.sum()), _places(sizes)
        number = np.fromiter(map(vocab.__getitem__, chain.from_iterable(lists)), np.int64, n)
        others = vocab.others
        of_others = np.array([vocab.classes[w] for w in others], np.int64)
        new = vocab.new(others, of_others)
        hashes = np.concatenate([hash_known, _hashes(others)])
        cls = np.concatenate([vocab.cls, of_others])[number]
        # A frequent word that is not cached is alone in its class.
        far = (number >= vocab.size) & (cls > FREQUENT)
        tokens = np.zeros(n + 2 * SIDE * len(lists), np.int64)
        tokens[places] = cls
        log_p = of_window[windows(tokens, places)].astype(np.float64)
        log_p += np.concatenate([vocab.log_n, np.zeros(len(others))])[number] - vocab.log_total[cls]
        total = np.diff(np.concatenate([[0.0], np.cumsum(log_p)])[np.concatenate([[0], np.cumsum(sizes)])])
        # The words on both sides, as one number with the class.
        around = np.zeros(len(tokens), np.uint64)
        around[places] = hashes[number]
        at, far_at = places[far], np.flatnonzero(far)
        with np.errstate(over="ignore"):
            context = mix64(mix64(around[at - 1] + np.uint64(1)) ^ (around[at + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ cls[far].astype(np.uint64))
        vocab.forget()
        ends = np.searchsorted(far_at, np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)
        as_lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
        return {
            "doc_id": s.column("doc_id"), "n_tokens": sizes, "known": total,
            "w": as_lists(hashes[number[far]].view(np.int64), pa.int64()), "c": as_lists(context.view(np.int64), pa.int64()),
            "new": as_lists(new[number[far] - vocab.size], pa.float64()), "k": as_lists(cls[far] - 1 - FREQUENT, pa.int32()),
        }

    schema = "doc_id long, n_tokens long, known double, w array<long>, c array<long>, new array<double>, k array<int>"
    part = map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)
    part = keep(part.withColumn("row", F.monotonically_increasing_id()))
    far = part.select("row", F.explode(F.arrays_zip("w", "c", "new", "k")).alias("x")).select("row", "x.*")
    # A word that isn't cached has 1 in CACHED of all tokens at most: no window is large.
    of_word, of_pair = Window.partitionBy("w"), Window.partitionBy("w", "c")
    counted = far.withColumns({"n": F.count("*").over(of_word), "together": F.count("*").over(of_pair)})
    base = F.when(F.col("n") > 1, F.log(F.col("n") - 1 - DISCOUNT)).otherwise(F.col("new"))
    counted = keep(counted.select("row", "c", "k", F.when(F.col("n") <= RARE, F.col("together")).alias("together"), base.alias("base")))
    sums = counted.where("together is null").groupBy("row").agg(F.sum("base").alias("rest"))
    near = counted.where("together is not null")
    contexts = near.groupBy("c").agg(F.count("*").alias("there")).where("there > 1")
    of_rare = F.element_at(F.array(*map(F.lit, rare.tolist())), F.col("k") + 1)
    mixed = F.log(SHARED * F.exp("base") + (1 - SHARED) * of_rare * (F.col("together") - 1) / (F.col("there") - 1))
    both = near.join(contexts, "c", "left").select("row", F.when(F.col("there") > 1, mixed).otherwise(F.col("base")).alias("p"))
    rest = sums.unionByName(both.groupBy("row").agg(F.sum("p").alias("rest"))).groupBy("row").agg(F.sum("rest").alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    out = part.select("row", "doc_id", "n_tokens", "known").join(rest, "row", "left").withColumn("log_likelihood", total)
    return out.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("score"), "log_likelihood", "n_tokens")
