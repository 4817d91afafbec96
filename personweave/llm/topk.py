"""Exact top-k search by term-at-a-time accumulation.

Terms are the vectors' components. Queries and candidates are packed into blocks of bounded size; each
block of queries meets each block of candidates once, in a grid of cells, one a task: it holds its
queries and reads its candidates one block after the other. The postings of each term are scattered, weighted by the
queries' components, into a dense array of scores, from which partition selection takes the best k of each
query; later blocks of the cell add what beats them. The cells' winners are merged.

Blocks are dealt by cell and sorted, not joined: a join may be planned as a broadcast, which sends all queries, once for
each column of the grid, through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import importable

SCALE = 1024
#: The largest number of 64 bits that a double holds.
MOST = float(2**63 - 1024)
#: Vectors in a block: of queries, of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Queries whose scores are made together.
GROUP = 32
#: Times that a scattered sum takes as long as one in a run.
SCATTERED = 8

#: Blocks of queries that a cell of the grid holds, and cells that a block of queries is sent to at most.
CELL_QUERIES, MOST_CELLS = 512, 64

_BLOCK = "ids binary, cells binary, width int, bytes int, slot long"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Integer rows of the vectors; shorter vectors lack the last terms (zeros)."""
    column = batch.column("embedding")
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).clip(-MOST, MOST).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold all of them."""
    least, most = int(cells.min(initial=0)), int(cells.max(initial=0))
    return cells.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _blocks(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        slot = (task.partitionId() if task else 0) * 7919
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                cells = _narrow(_matrix(part))
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                row = {"ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary()), "width": pa.array([cells.shape[1]], pa.int32()), "bytes": pa.array([cells.itemsize], pa.int32()), "slot": pa.array([slot], pa.int64())}
                yield pa.RecordBatch.from_pydict(row)
                slot += 1

    return run


class Postings:
    """Of a block of candidates, for each term the candidates that have it and their components."""

    def __init__(self, cells: np.ndarray) -> None:
        self.shape, self.most = cells.shape, _most(cells)
        self._values = {np.int32: np.ascontiguousarray(cells.T, np.int32)} if cells.itemsize <= 4 else {}
        self._values[np.int64] = None if self._values else np.ascontiguousarray(cells.T, np.int64)
        self.where = [np.flatnonzero(v) for v in next(v for v in self._values.values() if v is not None)]

    def values(self, kind: type) -> np.ndarray:
        if self._values.get(kind) is None:
            self._values[kind] = next(v for v in self._values.values() if v is not None).astype(kind)
        return self._values[kind]


def _most(cells: np.ndarray) -> int:
    return max(int(cells.max(initial=0)), -int(cells.min(initial=0)))


def accumulate(queries: np.ndarray, candidates: Postings) -> np.ndarray:
    """Scores (query, candidate): for each term, its postings weighted by the queries that have it.

    Postings lie term by term; queries go in groups whose scores stay in a processor's cache, and in
    32 bits where no sum can exceed them. A term that most have is added in one run, zeros and all.
    """
    n, terms = candidates.shape[0], min(queries.shape[1], candidates.shape[1])
    kind = np.int32 if _most(queries) * candidates.most * max(1, terms) < 1 << 31 else np.int64
    values, scores = candidates.values(kind), np.zeros((len(queries), n), kind)
    added = np.empty((GROUP, n), kind)
    for at in range(0, len(queries), GROUP):
        own, out = queries[at : at + GROUP].astype(kind), scores[at : at + GROUP]
        for term in range(terms):
            weights, where = own[:, term], candidates.where[term]
            having = np.flatnonzero(weights)
            if SCATTERED * len(having) * len(where) > len(own) * n:
                out += np.multiply(weights[:, None], values[term], out=added[: len(own)])
            elif len(having) and len(where):
                out[np.ix_(having, where)] += weights[having, None] * values[term, where]
    return scores


def select(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each query's k best scores, ties to the smaller vector id, its own left out."""
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, (q, row) in enumerate(zip(query_ids, scores, strict=True)):
        others = np.flatnonzero(ids != q)
        if len(others) > k:
            least = np.partition(row[others], len(others) - k)[len(others) - k]
            others = others[row[others] >= least]
        best = others[np.lexsort((ids[others], ~row[others]))[:k]]
        rows.append(np.full(len(best), at))
        columns.append(best)
    return np.concatenate(rows), np.concatenate(columns)


class Best:
    """The k best so far of each query of a block, by row of the block, from the best to the least."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, k: int) -> None:
        self.ids, self.cells, self.k = ids, cells, k
        self.rows, self.found, self.scores = (np.zeros(0, np.int64),) * 3
        self.full, self.least, self.last = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, candidates: Postings) -> None:
        """Takes in a block of candidates: what beats the k-th of a query that has k, the k best for one that has fewer."""
        scores = accumulate(self.cells, candidates)
        some = np.flatnonzero(~self.full)
        rows, columns = select(self.ids[some], ids, scores[some] if len(some) < len(scores) else scores, self.k)
        rows = some[rows]
        if self.full.any():
            bounds, least = np.iinfo(scores.dtype), self.least[:, None]
            if bounds.min <= least.min() and least.max() <= bounds.max:  # else compared in 64 bits
                least = least.astype(scores.dtype)
            better = (scores > least) | ((scores == least) & (ids < self.last[:, None]))
            better[~self.full] = False
            more, at = np.nonzero(better)
            other = ids[at] != self.ids[more]
            rows, columns = np.concatenate([rows, more[other]]), np.concatenate([columns, at[other]])
        if not len(rows):
            return
        rows, found = np.concatenate([self.rows, rows]), np.concatenate([self.found, ids[columns]])
        values = np.concatenate([self.scores, scores[rows[len(self.rows) :], columns].astype(np.int64)])
        order = np.lexsort((found, ~values, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.rows, self.found, self.scores = rows[kept], found[order][kept], values[order][kept]
        last = np.flatnonzero(place[kept] == self.k - 1)
        self.full[self.rows[last]] = True
        self.least[self.rows[last]], self.last[self.rows[last]] = self.scores[last], self.found[last]


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cells"], f"i{row['bytes']}").reshape(len(ids), row["width"])


def _winners(own: list[Best]) -> Iterator[pa.RecordBatch]:
    for block in own:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (block.ids[block.rows], block.found, block.scores)], names=["query_id", "vec_id", "score"])


def _cells(k: int) -> Callable:
    """Over blocks sorted by cell, the queries' before the candidates'."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from _winners(own)
                    cell, own = row["cell"], []
                ids, cells = _unpacked(row)
                if not row["candidate"]:
                    own.append(Best(ids, cells, k))
                elif own:
                    postings = Postings(cells)
                    for block in own:
                        block.meet(ids, postings)
        yield from _winners(own)

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Queries are the rows whose id is divisible by `every`, candidates all rows but those with the
    query's own id. A component x counts as floor(1024 x), at most MOST either way; scores are
    exact while they fit 64 bits, and beyond that what is left of them modulo 2^64, as a signed number. Ties go to the smaller id; rows that repeat an id are candidates each, and a query id that repeats
    is asked once, by the smallest of its vectors. Null vectors, null ids and vectors with a null or non-finite component take no
    part; a vector that is shorter lacks the last terms. Fewer candidates give fewer rows, an empty
    table none. Other columns are not read.
    """
    importable(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    asked = kept.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, n_queries = kept.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    down = -(-query_blocks // CELL_QUERIES)
    across = max(1, min(MOST_CELLS, -(-n // CANDIDATE_BLOCK)))
    queries, candidates = asked.coalesce(query_blocks).mapInArrow(_blocks(QUERY_BLOCK), _BLOCK), kept.mapInArrow(_blocks(CANDIDATE_BLOCK), _BLOCK)
    every_row, every_column = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))) for m in (down, across))
    queries = queries.withColumn("row", F.pmod("slot", F.lit(down))).withColumn("col", every_column).withColumn("candidate", F.lit(False))
    candidates = candidates.withColumn("row", every_row).withColumn("col", F.pmod("slot", F.lit(across))).withColumn("candidate", F.lit(True))
    blocks = queries.unionByName(candidates).select("ids", "cells", "width", "bytes", (F.col("row") * across + F.col("col")).cast("int").alias("cell"), "candidate")
    cells = blocks.repartitionById(down * across, "cell").sortWithinPartitions("cell", "candidate").mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
