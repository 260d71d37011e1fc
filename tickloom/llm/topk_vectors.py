"""Exact top-k search by inner product over an impact-ordered index, read score at a time.

A component x becomes floor(256 * x); a vector is a document with one posting per component, a query
term is a component of the query. The index is cut into shards of bounded size. In a shard, the
postings of a component stand in segments of equal quantised value; a segment knows its smallest and
largest value, so with a query component it has an impact interval. A query takes the segments of all
components by descending impact (measured above the smallest impact the component has in the shard,
so that no contribution is negative) and adds each segment's lower impact to its members. From what
is unread at a level every vector has at most ``level`` per unread component to gain, and from what
was read at most the widths of its segments. Reading stops once that proves all but a few vectors
below the best k known so far (an exact k-th score that only rises), or at the end of the segments;
vectors that the proof leaves possible are rescored exactly from the stored components, with equal
scores kept by smaller id. The result never depends on when reading stops.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of components. Each block is broadcast, all
shards flow past it in one pass, and its best rows are written before the next block begins. The k-th
score of every query within one shard (any one will do) is where reading starts from, so tasks give
back little beyond true members. One row per query, task and member is shuffled, for the last ranking.

Scores are exact: float64 products below 2^53, 64-bit ones below 2^63, Python's beyond; a score that
no long can hold is an error.

Defined cases: a null vector, one with a null or non-finite component, and an empty one take no part;
vectors of another length are compared as if the shorter one ended in zeros; a null id is a candidate,
never a query, and comes after equal scores with an id; repeated rows are candidates each, and a query
leaves out its own row only; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import drop, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
TOP = 5
#: Components of the queries that are broadcast at once, in bytes.
BLOCK_BYTES = 8 << 20
#: Components of one shard, in bytes.
SHARD_BYTES = 4 << 20
#: Segments per component at most.
LEVELS = 64
#: Share of the postings that is read between two looks at the bounds.
STEP = 0.125
#: Vectors that may stay possible when reading stops before the end: one in so many of the shard.
FEW = 64
NO_ID = np.iinfo(np.int64).max


# --- index ----------------------------------------------------------------------------------------

def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row, vec_id, comps`` of the vectors that take part; ``row`` tells equal rows apart."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(fit)
            .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                    F.transform("x", lambda c: F.floor(c * SCALE)).alias("comps")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    width = int(size.max(initial=0))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with zeros appended to the narrower one."""
    wide = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - b.shape[1])))


def _most(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``."""
    reach = a.shape[1] * _most(a) * _most(b)
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if _most(exact) >= 1 << 63:
        raise OverflowError("a score exceeds 64 bits")
    return exact.astype(np.int64)


class Shard:
    """Postings of some vectors by component, in segments of equal quantised value."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, comps: np.ndarray, order: np.ndarray):
        self.row, self.ids, self.comps = row, ids, comps
        n, dims = comps.shape
        value = np.take_along_axis(comps, order, 0).T
        low, high = value[:, :1], value[:, -1:]
        level = (value - low) * (LEVELS - 1) // np.maximum(high - low, LEVELS - 1)
        border = np.ones((dims, n), bool)
        border[:, 1:] = level[:, 1:] != level[:, :-1]
        start = np.flatnonzero(border)
        #: Postings component by component; a segment is a slice of them.
        self.posting = order.T.ravel()
        self.start, self.size = start, np.diff(np.append(start, dims * n))
        self.dim = start // n
        flat = value.ravel()
        self.low, self.high = flat[start], flat[start + self.size - 1]
        self.most = _most(comps)

    def impacts(self, query: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Per segment the largest impact above the smallest one of its component; the sum of these
        smallest ones; the most a vector can have above that sum."""
        q = query[self.dim]
        one, other = q * self.low, q * self.high
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, np.minimum(one, other))
        impact = np.maximum(one, other) - floor[self.dim]
        top = np.zeros(len(query), np.int64)
        np.maximum.at(top, self.dim, impact)
        return impact, int(floor.sum()), int(top.sum())

    def possible(self, query: np.ndarray, known: int | None) -> np.ndarray:
        """Vectors that no proof keeps below ``known`` (an exact k-th best score, or None)."""
        n, dims = self.comps.shape
        if known is None or 2 * dims * self.most * _most(query) >= 1 << 53:  # no score yet, or no exact sums
            return np.arange(n)
        impact, floor, top = self.impacts(query)
        if floor + top < known:
            return np.empty(0, np.int64)
        order = np.argsort(-impact, kind="stable")
        read = np.cumsum(self.size[order])
        bound, unread = np.full(n, floor, np.int64), np.full(n, dims, np.int64)
        done, left = 0, np.arange(n)
        while done < len(order) and len(left) > n // FEW:
            upto = int(np.searchsorted(read, (read[done - 1] if done else 0) + STEP * n * dims)) + 1
            part = order[done:upto]
            size = self.size[part]
            at = np.repeat(self.start[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            member = self.posting[at]
            bound += np.bincount(member, np.repeat(impact[part], size), n).astype(np.int64)
            unread -= np.bincount(member, minlength=n)
            done = upto
            # No segment still unread has a greater impact than the next one.
            level = int(impact[order[done]]) if done < len(order) else 0
            left = np.flatnonzero(bound + unread * level >= known)
        return left


def _shards(vectors: DataFrame) -> DataFrame:
    """The index: one row per shard with its components and, by component, its postings in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def row() -> pa.RecordBatch:
            comps = _matrix(pa.chunked_array([b.column("comps") for b in held]).combine_chunks())
            ids = pa.chunked_array([b.column("vec_id") for b in held]).combine_chunks()
            rows = pa.chunked_array([b.column("row") for b in held]).combine_chunks()
            order = np.argsort(comps, axis=0, kind="stable")
            cells = {"rows": rows.to_numpy(), "ids": ids.fill_null(NO_ID).to_numpy(), "comps": comps}
            return pa.RecordBatch.from_pydict(
                {"dims": pa.array([comps.shape[1]], pa.int32())}
                | {k: pa.array([v.astype("<i8").tobytes()], pa.binary()) for k, v in cells.items()}
                | {"postings": pa.array([order.astype("<i4").tobytes()], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                weight += 8 * len(part.column("comps").flatten())
                if weight >= SHARD_BYTES:
                    yield row()
                    held, weight = [], 0
        if held:
            yield row()

    return vectors.mapInArrow(run, "dims int, rows binary, ids binary, comps binary, postings binary")


def _read(dims: int, rows: bytes, ids: bytes, comps: bytes, postings: bytes) -> Shard:
    return Shard(np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(comps, "<i8").reshape(-1, dims),
                 np.frombuffer(postings, "<i4").reshape(-1, dims))


# --- search ---------------------------------------------------------------------------------------

class Best:
    """Exact best members of some queries so far."""

    def __init__(self, rows: np.ndarray, comps: np.ndarray, known: list[int | None], top: int):
        self.rows, self.comps, self.known, self.top = rows, comps, list(known), top
        none = np.empty(0, np.int64)
        self.score, self.ids = [none] * len(rows), [none] * len(rows)

    def see(self, shard: Shard) -> None:
        comps, queries = shard.comps, self.comps
        if comps.shape[1] < queries.shape[1]:
            shard = Shard(shard.row, shard.ids, comps := _alike(comps, queries)[0],
                          np.argsort(comps, axis=0, kind="stable"))
        elif comps.shape[1] > queries.shape[1]:
            queries = _alike(comps, queries)[1]
        for i, query in enumerate(queries):
            left = shard.possible(query, self.known[i])
            left = left[shard.row[left] != self.rows[i]]
            if not len(left):
                continue
            score = products(comps[left], query[None])[:, 0]
            if self.known[i] is not None:
                high = score >= self.known[i]
                left, score = left[high], score[high]
            score, found = np.concatenate([self.score[i], score]), np.concatenate([self.ids[i], shard.ids[left]])
            order = np.lexsort((found, -score))[:self.top]
            self.score[i], self.ids[i] = score[order], found[order]
            if len(order) == self.top:
                kth = int(score[order[-1]])
                self.known[i] = kth if self.known[i] is None else max(kth, self.known[i])


def _with_known(queries: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """The queries with their k-th best score inside one shard, null where that has too few rows."""
    first = [tuple(r) for r in index.limit(1).collect()]  # bounded by SHARD_BYTES
    share = queries.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_read(*r) for r in share.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                known = [None] * part.num_rows
                rows = part.column("row").to_numpy()
                for shard in shards:
                    score = products(*_alike(_matrix(part.column("comps")), shard.comps))
                    for i, r in enumerate(rows):
                        others = score[i][shard.row != r]
                        if len(others) >= top:
                            known[i] = int(np.partition(others, -top)[-top])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(known, pa.int64())],
                                                 [*part.schema.names, "known"])

    return queries.mapInArrow(run, "row long, vec_id long, comps array<long>, known long")


def _pass(index: DataFrame, block, top: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, comps, known = block.value
        best = Best(rows, comps, known, top)
        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best.see(_read(*cells))
        size = [len(s) for s in best.score]
        found = np.concatenate(best.ids)
        yield pa.RecordBatch.from_pydict({
            "query_row": np.repeat(rows, size), "query_id": np.repeat(ids, size),
            "vec_id": pa.array(found, mask=found == NO_ID), "score": np.concatenate(best.score)})

    return index.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def _blocks(queries: DataFrame) -> Iterator[tuple]:
    """ids, rows, components and known scores of the queries, in blocks of bounded size."""
    held, weight = [], 0

    def block() -> tuple:
        return (np.array([r.vec_id for r in held], np.int64), np.array([r.row for r in held], np.int64),
                _matrix(pa.array([r.comps for r in held], pa.list_(pa.int64()))), [r.known for r in held])

    for r in queries.toLocalIterator():
        held.append(r)
        weight += 8 * len(r.comps)
        if weight >= BLOCK_BYTES:
            yield block()
            held, weight = [], 0
    if held:
        yield block()


def search(vectors: DataFrame, every: int = 50, top: int = TOP, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every``, the ``top``
    other rows with the highest integer inner product, equal scores by smaller id."""
    spark = vectors.sparkSession
    stored = save(quantised(vectors, id_col, vector_col), "quantised")
    index = save(_shards(stored), "impact-index")
    queries = save(_with_known(stored.where(f"vec_id % {int(every)} = 0"), index, top), "queries")
    drop(stored)
    found = spark.createDataFrame([], "query_row long, query_id long, vec_id long, score long")
    for block in _blocks(queries):
        shared = spark.sparkContext.broadcast(block)
        found = found.unionByName(save(_pass(index, shared, top), "best-of-block"))
        shared.destroy()
    drop(index)
    drop(queries)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return (found.withColumn("rank", place).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
