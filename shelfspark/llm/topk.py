"""Exact top-k by inner product with pivot-table elimination.

A table keeps each vector with its distances to many pivots. Distances bound products: with
LB = max over pivots |d(q, p) - d(x, p)| no product of q and x is over (|q|^2 + |x|^2 - LB^2) / 2.
A query's candidates are evaluated in the order of these bounds until the next bound is under
the k-th score that it has; equal ones are evaluated, as their ids may be smaller.

Pivots are chosen far from each other among a bounded sample of ``SAMPLE`` rows. The same
sample gives each query a score that k candidates reach, so tasks drop most of what is not
in the result. Queries go in blocks of ``BLOCK_BYTES`` to all tasks (bounded broadcasts); each
block reads the table once, every task keeps k scores a query, and what tasks give is merged
by query.

Defined results: vectors that are null, or hold null or non-finite components, take no part.
A shorter vector counts as zero in what it lacks (so does an empty one). Of equal ids each
row takes part by itself, and a row of null id is a candidate after all others of its score.
Products are exact integers; a table whose products could pass 53 bits raises OverflowError.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import ROW_ID, drop_tables, write_table

#: Rows from which pivots are chosen, and pivots of them.
SAMPLE, PIVOTS = 2_048, 48
#: Bytes of a block of queries, and of the sample, which go to all tasks.
BLOCK_BYTES = 16 << 20
#: Candidates that are bounded at once, and queries whose bounds are held at once.
TILE, PART = 1_024, 128
#: Components are multiplied by this and rounded down.
SCALE = 64
#: What rounding to 32 bits can add to a difference of distances, for each unit of them.
SLACK = 1e-6
#: The order of a candidate without id.
LAST = np.iinfo(np.int64).max

TABLE = f"{ROW_ID} bigint, id bigint, vector binary, distances binary"
FOUND = "query_row bigint, query_id bigint, id bigint, row bigint, score bigint"


def scaled(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(__row_id, id, vector): floor(SCALE * x) of the components of vectors that have only finite ones."""
    x = F.col(vector_column)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    vector = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    return rows.where(whole).select(F.monotonically_increasing_id().alias(ROW_ID), F.col(id_column).cast("bigint").alias("id"), vector.alias("vector"))


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    sizes = vectors.value_lengths().to_numpy()
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``sample``, each the farthest from those before it."""
    chosen = sample[:1]
    far = _distances(sample, chosen).min(1) if len(sample) else np.zeros(0)
    while 0 < len(chosen) < n and far.max() > 0:
        chosen = np.vstack([chosen, sample[far.argmax()]])
        far = np.minimum(far, _distances(sample, chosen[-1:])[:, 0])
    return chosen


def _best(scores: np.ndarray, order: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row of ``scores`` by score descending, order ascending, row ascending."""
    by = np.lexsort((rows, order, -scores), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, by, 1) for x in (scores, order, rows))


class Search:
    """The k best candidates of a block of queries among the tiles given so far."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, distances: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.queries, self.own, self.distances, self.floors, self.k = queries, own, distances, floors, k
        self.squares = (queries * queries).sum(1)
        n = len(queries)
        self.scores, self.order, self.rows = np.full((n, k), -np.inf), np.full((n, k), LAST), np.full((n, k), LAST)
        self.evaluated = 0

    def add(self, vectors: np.ndarray, order: np.ndarray, rows: np.ndarray, distances: np.ndarray) -> None:
        """``rows`` names the candidates, and ``order`` puts those of equal scores in order."""
        squares, far = (vectors * vectors).sum(1), distances.max(1, initial=0)
        for start in range(0, len(self.queries), PART):
            part = slice(start, start + PART)
            lower = np.zeros((len(self.queries[part]), len(vectors)), np.float32)
            for p in range(distances.shape[1]):
                np.maximum(lower, np.abs(self.distances[part, p, None] - distances[None, :, p]), out=lower)
            top = self.squares[part, None] + squares[None, :]
            slack = SLACK * (1 + self.distances[part].max(1, initial=0)[:, None] + far[None, :])
            bounds = (top - np.maximum(lower - slack, 0) ** 2) / 2 + 1e-9 * (1 + top)
            bounds[self.own[part, None] == rows[None, :]] = -np.inf
            at = np.arange(len(self.queries))[part]
            some = bounds.max(1, initial=-np.inf) >= np.maximum(self.scores[at, -1], self.floors[at])
            self._evaluate(at[some], bounds[some], vectors, order, rows)

    def _evaluate(self, at: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, order: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of the queries ``at`` in rounds by bound, until a query's next bound is under its k-th score."""
        by = np.argsort(-bounds, axis=1)
        done, step = 0, max(2 * self.k, 32)
        while done < by.shape[1]:
            took = by[:, done : done + step]
            ahead = np.take_along_axis(bounds, took, 1)
            least = np.maximum(self.scores[at, -1], self.floors[at])
            going = (ahead[:, 0] >= least) & (ahead[:, 0] > -np.inf)
            if not going.any():
                return
            at, by, bounds, took, ahead = at[going], by[going], bounds[going], took[going], ahead[going]
            scores = np.einsum("qcd,qd->qc", vectors[took], self.queries[at])
            self.evaluated += scores.size
            scores[ahead == -np.inf] = -np.inf
            self.scores[at], self.order[at], self.rows[at] = _best(
                *(np.hstack(x) for x in ((self.scores[at], scores), (self.order[at], order[took]), (self.rows[at], rows[took]))), self.k
            )
            done, step = done + step, 2 * step

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, order, row) of what may be in the result."""
        good = (self.scores > -np.inf) & (self.scores >= self.floors[:, None])
        return np.nonzero(good)[0], self.scores[good], self.order[good], self.rows[good]


def floors(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample reach, itself left out; minus infinity if it has fewer."""
    scores = queries @ sample.T
    scores[own[:, None] == sample_rows[None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(queries), -np.inf)


def _limits(rows: DataFrame) -> tuple[int, np.dtype]:
    """Components of the longest vector, and the smallest kind that holds all values."""
    sizes = rows.select(F.size("vector").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))).alias("most"))
    dims, most = (x or 0 for x in sizes.agg(F.max("n"), F.max("most")).first())
    if dims * most * most >= 1 << 53:
        raise OverflowError(f"products of {dims} components up to {most:g} are not exact in 53 bits")
    return dims, next(kind for kind in map(np.dtype, ("int8", "int16", "int32")) if most <= np.iinfo(kind).max)


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", block_bytes: int = BLOCK_BYTES, tile: int = TILE, sample: int = SAMPLE, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for each row that ``is_query`` says by its id."""
    spark = vectors.sparkSession
    rows = write_table(scaled(vectors, id_column, vector_column), "vectors")
    dims, kind = _limits(rows)
    # Places of rows say nothing of what they hold, so the first of a hash order are a sample.
    held = rows.orderBy(F.xxhash64(ROW_ID), ROW_ID).limit(max(1, min(sample, block_bytes // (8 * max(dims, 1))))).toArrow()
    near, near_rows = _matrix(held.column("vector").combine_chunks(), dims), held.column(ROW_ID).to_numpy()
    points = choose_pivots(near, pivots)

    def binary(m: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes() for x in m], pa.binary())

    def matrix(column: pa.Array, width: int, kind: str | np.dtype) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            columns = [batch.column(ROW_ID), batch.column("id"), binary(x.astype(kind)), binary(_distances(x, points).astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, names=[ROW_ID, "id", "vector", "distances"])

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, tile):
                part = batch.slice(start, tile)
                x = matrix(part.column("vector"), dims, kind).astype(float)
                yield part.append_column("floor", pa.array(floors(x, part.column(ROW_ID).to_numpy(), near, near_rows, k)))

    table = write_table(rows.mapInArrow(measure, TABLE), "pivot-table")
    drop_tables(rows)
    asking = write_table(table.where(is_query(F.col("id"))).mapInArrow(floored, f"{TABLE}, floor double"), "queries")
    blocks = max(1, -(-asking.count() * 8 * (dims + len(points) + 3) // block_bytes))
    parts = []
    for b in range(blocks):
        own = asking.where(F.pmod(F.xxhash64(ROW_ID), F.lit(blocks)) == b).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(
            (matrix(own.column("vector"), dims, kind), own.column(ROW_ID).to_numpy(), own.column("id").to_numpy(), matrix(own.column("distances"), len(points), np.float32), own.column("floor").to_numpy())
        )

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, own, ids, distances, least = sent.value
            state = Search(queries.astype(float), own, distances, least, k)
            for batch in batches:
                for start in range(0, batch.num_rows, tile):
                    part = batch.slice(start, tile)
                    x, d = matrix(part.column("vector"), dims, kind).astype(float), matrix(part.column("distances"), len(points), np.float32)
                    state.add(x, part.column("id").fill_null(LAST).to_numpy(), part.column(ROW_ID).to_numpy(), d)
            at, scores, order, rows = state.found()
            columns = [pa.array(own[at]), pa.array(ids[at]), pa.array(order, mask=order == LAST), pa.array(rows), pa.array(scores.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

        parts.append(write_table(table.mapInArrow(search, FOUND), "found"))
    drop_tables(table, asking)
    merged = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
