"""Packing tokenized documents into sequences by minimum bin slack.

A document is its token ids and a separator. Longer documents are cut; all the pieces are packed. The
solver needs the number of pieces of each length only, capacity numbers at most: per bin it takes the
largest length left and finds, by subset-sum dynamic programming over a bitset, the fullest combination
of the lengths left; that combination is used for as many bins as the counts allow. Pieces find their
bin by their rank among pieces of their length, so no task ever holds all of a length.

Edge cases: a null or empty text is one piece of the separator alone; equal rows are packed as often as
they occur; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import arrow_schema, as_batch, lean, map_text, materialize, releasing

CAPACITY = 4096
SEPARATOR = 1
#: Groups that each length is dealt into while ranks are counted.
SALTS = 256
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Memo(dict):
    """A function's results by argument. Past size entries the older half is forgotten, except what is
    asked for again."""

    def __init__(self, fn, size: int) -> None:
        super().__init__()
        self.fn, self.half, self.old = fn, size // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


class FastEncoder:
    """The ids of a tokenizers file of the word-end kind, word by word.

    Its pre-tokenizer never looks across white space, so words between white space are encoded apart and
    their ids kept as bytes. Texts with characters that Python and the tokenizer may class differently go
    through the tokenizer as a whole.
    """

    # Fixed value: the file's own pre-tokenizer pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What is safe: printable ASCII, line breaks, precomposed Latin letters and common punctuation.
    SAFE = bytes([9, 10, 13, *range(32, 127)])
    UNSURE = regex.compile(r"[^\t\n\r -~¡-įı-ſ‐-‧‰-⁞€]")
    WORDS, PIECES = 400_000, 400_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.pattern = self.whole.model, regex.compile(self.PATTERN)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.table = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.pieces, self.words = Memo(self._piece, self.PIECES), Memo(self._word, self.WORDS)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        low = word.lower()  # precomposed already: NFC changes nothing in safe text
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".,;:!?" and (head := low[:-1]).isalpha():
            return self.pieces[head] + self.pieces[low[-1]]
        return b"".join([self.pieces[p] for p in self.pattern.findall(low)])

    def safe(self, text: str) -> bool:
        if "<|" in text:  # special tokens are recognised in text
            return False
        return not text.encode().translate(None, self.SAFE) if text.isascii() else not self.UNSURE.search(text)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers."""
        if self.safe(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(4)
def encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: (doc_id, piece, start, length, ids_crc32)."""
    end = struct.pack("<I", SEPARATOR)

    def run(s: pa.RecordBatch) -> dict:
        enc, out = encoder(tokenizer), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for d, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), strict=True):
            ids = (enc.encode(t) if t else b"") + end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for k, v in zip(out, (d, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[k].append(v)
        return out

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PIECE, run)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used counts times at most, with the greatest sum that is room at most."""
    if room <= 0:
        return []
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used += [length] * take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> times in the bin, number of such bins). Each entry exhausts some length for its
    own number of uses, so there are O(capacity log capacity) entries however many pieces there are."""
    left, bins = {x: n for x, n in counts.items() if n > 0}, []
    for top in sorted(left, reverse=True):
        while left[top] > 0:
            left[top] -= 1
            use = [top, *fullest(left, capacity - top)]
            left[top] += 1
            need = {x: use.count(x) for x in set(use)}
            times = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            bins.append((need, times))
    return bins


def placements(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses per bin, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for need, times in bins:
        offset = 0
        for length in sorted(need, reverse=True):
            rows.append((length, used.get(length, 0), first, need[length], offset))
            used[length] = used.get(length, 0) + need[length] * times
            offset += length * need[length]
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which is read three times."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = placements(plan(counts, capacity))
    held = pieces.sparkSession.sparkContext.broadcast(table)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    ranked = salted.join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = arrow_schema(PIECE + ", sequence_id long, offset long")

    def place(batches):
        t = held.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = t[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(length) else t[:0]
            nth = rank - row[:, 1]
            yield as_batch(schema, {c: b.column(c) for c in names} | {"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length})

    return ranked.select(*names, "_rank").mapInArrow(lean(place), PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes once, into a small table in the shared folder, then packs; the result is a stored table."""
    with releasing() as keep:
        return materialize(pack(keep(tokenize(docs, tokenizer, capacity)), capacity))
