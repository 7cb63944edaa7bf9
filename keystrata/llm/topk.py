"""Exact inner-product top-k by ball-tree branch and bound in each shard.

1. Cells. Vectors become integers and are dealt into cells, each around its pivot, a vector of a bounded
   seed sample; a cell's radius is the largest distance from its pivot. Cells are cut into shards of
   SHARD_BYTES at most, row by row, so that copies of a vector or of an id are spread.
2. Floors. A query's kth score starts at the kth best of the seed sample. In the first round each query is
   searched in one shard of the cell whose pivot suits it best; the kth score found there, if higher, is
   shared with all other shards.
3. In the second round a query is sent only to shards whose cell can still reach its kth score: the upper
   bound is q . pivot + |q| radius. In a shard a task builds its ball tree and streams the queries past it;
   nodes are taken in the order of their bounds and left once the bound is below the query's kth score.

Components become floor(scale * x) in double precision, and scores are exact integers: in double arithmetic
where no sum can leave 2^53, else by whole numbers for the rows that rounding can't exclude. Scores beyond 64
bits are set to the nearest number of 64 bits, and tie there.

Edge cases: vectors that are null or empty, hold a null or a non-finite component or one beyond 1e150 after
scaling, or belong to a null id take no part; fewer candidates than k give all; ties go to the smaller id;
equal rows are one candidate, rows of one id with different vectors are several; as queries, such rows share
one list. Vectors of different lengths are compared with their own length only.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from keystrata.llm.common import arrow_schema, as_batch, materialize, releasing

LEAF, SEED_ROWS = 64, 1024
#: Vectors (as doubles) that a shard holds, shards at least, cells at most for each vector length.
SHARD_BYTES, LEAST_SHARDS, CELLS = 64 << 20, 12, 1024
#: Tasks of a search at most, and bytes of queries in one batch.
TASKS, QUERY_BYTES = 1 << 15, 4 << 20
LARGEST, EXACT = 1e150, 2.0**53
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(x: float) -> float:
    """A double that is not above the number that x was rounded from."""
    return float(np.nextafter(x, -np.inf)) if abs(x) >= EXACT else x


def _error(length: float, norm: float, dim: int) -> float:
    """What rounding may change in an inner product of vectors of these lengths; 0 where it changes nothing."""
    return 0.0 if length * norm < EXACT else length * norm * (dim + 4) * 2.0**-52


def whole_score(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of integers that doubles hold, within 64 bits."""
    return max(LOW, min(HIGH, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


class BallTree:
    """Balls over the rows of x (integers as doubles); ids break ties."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        if len(np.unique(ids)) < len(ids):  # equal rows are one
            both = np.ascontiguousarray(np.column_stack([ids.view(np.float64), x + 0.0]))
            first = np.unique(both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel(), return_index=True)[1]
            ids, x = ids[first], x[first]
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        self.centre, self.radius, self.rows, self.children = [], [], [], []
        self._build(np.arange(len(ids)))
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)

    def _build(self, root: np.ndarray) -> None:
        todo = [(root, -1)]
        while todo:
            rows, parent = todo.pop()
            me = len(self.rows)
            pts = self.x[rows]
            c = pts.mean(axis=0)
            d = np.sqrt(((pts - c) ** 2).sum(axis=1))
            self.centre.append(c)
            self.radius.append(float(d.max()) * (1 + 1e-9) + 1e-6)
            self.rows.append(rows)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if len(rows) > LEAF and (pts != pts[0]).any():
                far = pts[d.argmax()]
                other = pts[((pts - far) ** 2).sum(axis=1).argmax()]
                order = np.argsort(pts @ (other - far), kind="stable")
                half = len(rows) // 2
                todo += [(np.sort(rows[order[half:]]), me), (np.sort(rows[order[:half]]), me)]

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) for q that reach floor, without rows of the id own."""
        length = float(np.sqrt(q @ q))
        error = _error(length, self.norm, len(q))
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        bounds = self.centres @ q + length * self.radii * (1 + 1e-9) + 1e-3 + 2 * error
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heappop(heap)
            if -bound < floor:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bounds[c] >= floor:
                        heappush(heap, (-bounds[c], c))
                continue
            rows = self.rows[node]
            scores = self.x[rows] @ q
            hit = np.flatnonzero((scores >= floor - error) & (self.ids[rows] != own))
            if not len(hit):
                continue
            if not error:
                # Of a large leaf of equal vectors only the smallest ids matter; rows are in the ids' order.
                hit = hit[np.argsort(-scores[hit], kind="stable")[:k]]
                found = [(-int(s), i) for s, i in zip(scores[hit].tolist(), self.ids[rows[hit]].tolist(), strict=True)]
            else:
                # Vectors are often repeated here: each is multiplied once.
                made: dict[bytes, int] = {}
                found = []
                for r in rows[hit]:
                    x = self.x[r]
                    name = x.tobytes()
                    if name not in made:
                        made[name] = whole_score(x, q)
                    found.append((-made[name], int(self.ids[r])))
            best = sorted(best + found)[:k]
            if len(best) == k and -best[-1][0] > LOW:
                floor = max(floor, _below(float(-best[-1][0])))
        return [(-s, i) for s, i in best]


def _pack(x: np.ndarray) -> bytes:
    """Four bytes a component where they suffice, else eight."""
    small = len(x) and np.abs(x).max() < 2.0**31
    return x.astype("<i4" if small else "<f8").tobytes()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of one length as doubles."""
    parts = column.to_pylist()
    if all(len(p) == 4 * dim for p in parts):
        return np.frombuffer(b"".join(parts), "<i4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(p, "<i4" if len(p) == 4 * dim else "<f8").astype(np.float64) for p in parts])


def _vectors(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for those that take no part."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    ok = np.abs(values) <= LARGEST
    ends = np.cumsum(lens)
    return [values[e - n : e] + 0.0 if n and ok[e - n : e].all() else None for n, e in zip(lens.tolist(), ends.tolist(), strict=True)]


STORED = "vec_id long, dim int, v binary, asked boolean, cell int, far double"
PAIR = "vec_id long, dim int, v binary, floor double, shard int"
FOUND = "query_id long, mark long, vec_id long, score long"


def _seeds(rows: DataFrame, total: int, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of SEED_ROWS different rows at most, by vector length, drawn by a hash of the id. Rows
    are thinned before the sort, or every task would send SEED_ROWS vectors to the driver."""
    share = min(1.0, 4 * SEED_ROWS / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    few = drawn.select("vec_id", "x").distinct().orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("x")).limit(SEED_ROWS).toArrow()
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in zip(few.column("vec_id").to_pylist(), _vectors(few.column("x").combine_chunks(), scale), strict=True):
        if v is not None:
            by.setdefault(len(v), []).append((i, v))
    return {d: (np.array([i for i, _ in part], np.int64), np.array([v for _, v in part])) for d, part in by.items()}


class Plan:
    """Cells and shards, with the seeds: what each task needs to know of the whole. Bounded by CELLS and
    SEED_ROWS for each vector length."""

    def __init__(self, seeds: dict[int, tuple[np.ndarray, np.ndarray]], bytes_of: dict[int, int]) -> None:
        self.seeds = seeds
        self.shard_bytes = max(1, min(SHARD_BYTES, -(-sum(bytes_of.values()) // LEAST_SHARDS)))
        self.pivots = {}
        for d, size in bytes_of.items():
            have = np.unique(seeds[d][1], axis=0) if d in seeds else np.zeros((1, d))
            want = min(CELLS, max(1, -(-size // self.shard_bytes)), len(have))
            self.pivots[d] = have[np.linspace(0, len(have) - 1, want).astype(int)]
        self.radius: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}
        self.shards = 0

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and the distance from it."""
        p = self.pivots[x.shape[1]]
        near = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
        return near, np.sqrt(((x - p[near]) ** 2).sum(axis=1))

    def measure(self, cells: list) -> None:
        """cells: rows (dim, cell, rows, far)."""
        for d, p in self.pivots.items():
            self.radius[d], self.parts[d] = np.full(len(p), -1.0), np.zeros(len(p), np.int64)
        for r in cells:
            self.radius[r["dim"]][r["cell"]] = r["far"] * (1 + 1e-9) + 1e-6
            self.parts[r["dim"]][r["cell"]] = -(-r["rows"] * r["dim"] * 8 // self.shard_bytes)
        for d in sorted(self.parts):
            self.first[d] = self.shards + np.cumsum(self.parts[d]) - self.parts[d]
            self.shards += int(self.parts[d].sum())

    def floor(self, own: int, q: np.ndarray, k: int) -> float:
        """The kth best score among the seeds, or a little less."""
        ids, x = self.seeds.get(len(q), (np.zeros(0), None))
        others = np.flatnonzero(ids != own)
        if len(others) < k:
            return float("-inf")
        kth = float(np.sort(x[others] @ q)[-k])
        norm = float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        floor = _below(min(kth, float(HIGH)) - _error(float(np.sqrt(q @ q)), norm, len(q)))
        return floor if floor > LOW else float("-inf")

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The products with the pivots, and the upper bounds of the cells."""
        p, r = self.pivots[len(q)], self.radius[len(q)]
        length = float(np.sqrt(q @ q))
        near = p @ q
        reach = float(np.sqrt(np.einsum("ij,ij->i", p, p).max())) + max(0.0, float(r.max()))
        return near, np.where(r >= 0, near + length * r * (1 + 1e-9) + 1e-3 + 2 * _error(length, reach, len(q)), -np.inf)

    def home(self, own: int, q: np.ndarray) -> int:
        """The shard that a query is searched in first."""
        near, bounds = self.bounds(q)
        c = int(np.where(bounds > -np.inf, near, -np.inf).argmax())
        return int(self.first[len(q)][c]) + own % int(self.parts[len(q)][c])

    def others(self, own: int, q: np.ndarray, floor: float) -> list[int]:
        """The shards that can reach floor, without the first one."""
        d, home = len(q), self.home(own, q)
        cells = np.flatnonzero(self.bounds(q)[1] >= floor)
        return [s for c in cells for s in range(int(self.first[d][c]), int(self.first[d][c] + self.parts[d][c])) if s != home]


def _pairs(asked: DataFrame, plan, first: bool, k: int) -> DataFrame:
    """asked: (vec_id, dim, v), and kth in the second round. A row for each query and shard that it goes to."""
    schema = arrow_schema(PAIR)

    def run(batches):
        p, out, size = plan.value, {f.name: [] for f in schema}, 0
        for b in batches:
            kths = b.column("kth").to_pylist() if not first else [None] * b.num_rows
            for own, dim, v, kth in zip(b.column("vec_id").to_pylist(), b.column("dim").to_pylist(), b.column("v").to_pylist(), kths, strict=True):
                q = np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<f8").astype(np.float64)
                floor = p.floor(own, q, k)
                if kth is not None and kth > LOW:
                    floor = max(floor, _below(float(kth)))
                for s in [p.home(own, q)] if first else p.others(own, q, floor):
                    for c, x in zip(out, (own, dim, v, floor, s), strict=True):
                        out[c].append(x)
                    size += len(v)
                    if size > QUERY_BYTES:
                        yield as_batch(schema, out)
                        out, size = {f.name: [] for f in schema}, 0
        yield as_batch(schema, out)

    return asked.mapInArrow(run, PAIR)


def _search(stored: DataFrame, pairs: DataFrame, shards: int, k: int) -> DataFrame:
    """FOUND rows: the k best of each pair's shard that reach its floor."""
    schema = arrow_schema(FOUND)

    def search(batches):
        now, parts, tree = None, [], None
        for b in batches:
            shard, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
            cut = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(shard)]
            for at, end in zip(cut, cut[1:], strict=False):
                if at == end:
                    continue
                s = b.slice(at, end - at)
                if now != shard[at]:
                    now, parts, tree = shard[at], [], None
                ids, x = s.column("vec_id").to_numpy(), _matrix(s.column("v"), s.column("dim")[0].as_py())
                if kind[at] == 0:
                    parts.append((ids, x))
                    continue
                if tree is None:
                    tree, parts = BallTree(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                out = {f.name: [] for f in schema}
                for own, q, v, floor in zip(ids.tolist(), x, s.column("v").to_pylist(), s.column("floor").to_pylist(), strict=True):
                    mark = xxh3_64_intdigest(v) - (1 << 63)
                    for score, i in tree.search(q, own, k, floor):
                        for c, value in zip(out, (own, mark, i, score), strict=True):
                            out[c].append(value)
                yield as_batch(schema, out)

    kinds = stored.select("vec_id", "dim", "v", F.lit(0.0).alias("floor"), "shard", F.lit(0).alias("kind")).unionByName(pairs.withColumn("kind", F.lit(1)))
    tasks = max(1, min(shards, TASKS))
    # Dealt by number: hashing a few shards leaves tasks empty, and gives others several.
    dealt = kinds.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks))).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(search, FOUND).distinct()


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each row that queries marks; as a
    stored table."""
    with releasing() as keep:
        return materialize(_top_k(vectors, queries, k, scale, id, vector, keep))


def _top_k(vectors: DataFrame, queries: Column, k: int, scale: int, id: str, vector: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    context = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col(id).isNotNull() & (F.size(vector) > 0)).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("asked"))
    dims = {r["dim"]: r["n"] for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plan = Plan(_seeds(rows, sum(dims.values()), float(scale)), {d: 8 * d * n for d, n in dims.items()})
    held, schema = context.broadcast(plan), arrow_schema(STORED)

    def place(batches):
        for b in batches:
            xs = _vectors(b.column("x"), float(scale))
            out = {f.name: [] for f in schema}
            ids, asked = b.column("vec_id").to_pylist(), b.column("asked").to_pylist()
            for d in sorted({len(x) for x in xs if x is not None}):
                mine = [i for i, x in enumerate(xs) if x is not None and len(x) == d]
                cell, far = held.value.cell(np.stack([xs[i] for i in mine]))
                for c, values in zip(out, ([ids[i] for i in mine], [d] * len(mine), [_pack(xs[i]) for i in mine], [asked[i] for i in mine], cell.tolist(), far.tolist()), strict=True):
                    out[c] += values
            yield as_batch(schema, out)

    placed = keep(rows.mapInArrow(place, STORED).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    plan.measure(placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect())
    # A row for each cell that holds rows: CELLS at most for each vector length.
    table = [(d, c, int(plan.first[d][c]), int(n)) for d in plan.parts for c, n in enumerate(plan.parts[d]) if n]
    cells = vectors.sparkSession.createDataFrame(table, "dim int, cell int, first int, parts int")
    stored = placed.join(F.broadcast(cells), ["dim", "cell"]).withColumn("shard", (F.col("first") + F.pmod("deal", F.col("parts"))).cast("int"))
    held2 = context.broadcast(plan)
    asked = keep(placed.where("asked").select("vec_id", "dim", "v").distinct())
    near = keep(_search(stored, _pairs(asked, held2, True, k), plan.shards, k))
    mark = F.col("mark")
    kth = near.groupBy("query_id", mark).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    marks = arrow_schema("vec_id long, dim int, v binary, mark long")

    def add_mark(batches):
        for b in batches:
            yield as_batch(marks, {c: b.column(c) for c in ("vec_id", "dim", "v")} | {"mark": [xxh3_64_intdigest(v) - (1 << 63) for v in b.column("v").to_pylist()]})

    marked = asked.mapInArrow(add_mark, "vec_id long, dim int, v binary, mark long")
    again = marked.join(kth.select(F.col("query_id").alias("vec_id"), "mark", "kth"), ["vec_id", "mark"], "left").select("vec_id", "dim", "v", "kth")
    found = near.unionByName(_search(stored, _pairs(again, held2, False, k), plan.shards, k)).select("query_id", "vec_id", "score").distinct()
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
