"""What the operators share: chunked text, word shingles, grouped streams, components; and the scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from keystrata.sources.scratch import materialize, release, releasing, shared_dir

__all__ = ["arrow_schema", "as_batch", "components", "grouped", "keep_rows", "lean", "map_text", "materialize", "mix64", "release", "releasing", "shared_dir", "shingles", "text_slices", "unused", "words"]

#: Text handled at once inside a task.
CHUNK_BYTES = 1 << 20


# -- Arrow streams --------------------------------------------------------------------------------


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives what it no longer uses back to the system at its end: a worker lives on for other tasks,
    beside those of its neighbours."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped


def as_batch(schema: StructType | pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, end - at)
        done, at = int(ends[end - 1]), end


def map_text(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], column: str = "text") -> DataFrame:
    """mapInArrow with fn applied to slices of bounded text; fn gives columns by name, or None for no rows."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, column):
                out = fn(s)
                if out is not None:
                    yield as_batch(target, out)

    return df.mapInArrow(lean(run), schema)


def keep_rows(df: DataFrame, fn: Callable[[list], np.ndarray], column: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text fn marks true (fn takes a list of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, column):
                yield s.filter(pa.array(fn(s.column(column).to_pylist())))

    return df.mapInArrow(lean(run), df.schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_schema(ddl: str) -> pa.Schema:
    return _arrow_schema(None, ddl)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream sorted by keys, one table each. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            here = tuple(b.column(k)[at].as_py() for k in keys)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def unused(columns: Iterable[str], name: str) -> str:
    """A column name like name that none of columns has (names don't tell cases apart)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


# -- words and shingles ---------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of each text, one after the other, and where each text's begin
    (one more offset than texts). Repeated shingles stay. A text of fewer words is one shingle; a text
    without words has none."""
    lists = [words(t) for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(lens.sum())
    h = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, n)
    starts = np.concatenate([[0], np.cumsum(lens)])
    counts = np.where(lens >= k, lens - k + 1, np.minimum(lens, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    pos = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], counts) + np.repeat(starts[:-1], counts)
    m = max(n - k + 1, 0)
    s = np.full(max(m, 1), k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            s[:m] = (s[:m] ^ h[j : m + j]) * _MULT
            s[:m] ^= s[:m] >> np.uint64(29)
    out = s[np.minimum(pos, len(s) - 1)]
    for i in np.flatnonzero((lens > 0) & (lens < k)):
        out[offsets[i]] = xxh3_64_intdigest(b" ".join(lists[i]), seed=int(lens[i]))
    return mix64(out), offsets


# -- connected components -------------------------------------------------------------------------


#: Edges that one task joins at most.
SMALL_EDGES = 1 << 20


def _joined(edges: DataFrame) -> DataFrame:
    """The components of few edges (u, v) by union-find in one task, on numbers of 16 bytes an edge."""
    schema = arrow_schema("id long, component long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (p := parent.setdefault(i, i)) != i:
                parent[i] = i = parent.setdefault(p, p)
            return i

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                x, y = find(u), find(v)
                parent[max(x, y)] = min(x, y)
        ids = list(parent)
        for at in range(0, len(ids), 100_000):
            part = ids[at : at + 100_000]
            yield as_batch(schema, {"id": part, "component": list(map(find, part))})

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b), as a stored table: the component is its smallest id.

    SMALL_EDGES at most are joined in one task. More take alternating large-star and small-star steps,
    O(log^2 n) rounds; each round is two aggregations that combine before the exchange and two joins, and ends
    in a table in the shared folder. Nothing but a count and a checksum per round reaches the driver.
    """
    cur, mark = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    if cur.count() <= SMALL_EDGES:
        out = materialize(_joined(cur))
        release(cur)
        return out
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small)
        release(cur, low, large, low2)
        seen = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        cur = new
        if seen == mark:
            break
        mark = seen
    roots = cur.select(F.col("v").alias("id")).distinct()
    out = materialize(cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))))
    release(cur)
    return out
