"""Exact top-k search by inner product with the threshold algorithm.

Each task sorts every dimension of a block of candidates once. For a query the
lists are read from their best end, all to the same depth; rows met for the
first time are scored in full, and the bound is the score of a row that would
be as good as the last entry read in every list. The search of a block stops
when the bound is below the k-th best score so far, which carries over from
block to block. Equal scores go to the smaller id, so a bound equal to the k-th
score doesn't stop it.

Queries are a stated set; they are broadcast in blocks of at most
``QUERY_BLOCK`` rows and each block is written out before the next is read, so
neither driver nor broadcast grows with the data. Tasks return k rows a query.

Components become floor(1024 * x), x as double. Rows that are null or hold
null or non-finite components take no part. Only vectors of the query's
dimension are candidates. A candidate with the query's id is the query itself,
however often it is repeated; other repeated rows are candidates each;
repeated queries with equal vectors are answered once. Scores beyond a long
are cut to the nearest long, and rank by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
#: Candidates whose lists are sorted together.
BLOCK = 16384
SCALE = 1024
#: Depth of the first round of sorted reads; later rounds double it.
FIRST_DEPTH = 32
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): rows whose components are all there and finite, as doubles."""
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fine))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): doubles, or Python's whole numbers where the product is beyond a double."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    if np.isfinite(out).all():
        return out
    return np.array([int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.reshape(-1).tolist()], object).reshape(x.shape)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scaled components, a pair for each dimension that occurs."""
    column = batch.column(1)
    ids = batch.column(0).to_numpy()
    at = np.asarray(column.offsets)
    flat = column.values.to_numpy()[at[0] : at[-1]] if len(at) else np.zeros(0)
    sizes = np.diff(at)
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        place = (at[own] - at[0])[:, None] + np.arange(d)
        yield ids[own], scaled(flat[place])


class Search:
    """The k best of some queries over blocks of candidates."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.largest = int(max(map(abs, queries.reshape(-1).tolist()), default=0))
        self.scored = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        most = int(max(map(abs, x.reshape(-1)), default=0) if x.dtype == object else np.abs(x).max(initial=0))
        exact = self.largest * most * max(1, x.shape[1]) >= 2**53 or object in (x.dtype, self.queries.dtype)
        if exact:  # whole numbers beyond a double's: python's
            x = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        order = np.argsort(x, axis=0, kind="stable").T.copy()
        lists = np.take_along_axis(x.T, order, axis=1)
        for i, (own, q) in enumerate(zip(self.ids, self.queries, strict=True)):
            q = np.array([int(v) for v in q], object) if exact else q
            self.best[i] = self._one(own, q, ids, x, order, lists, self.best[i])

    def _one(self, own, q, ids, x, order, lists, best):
        n, dims = len(ids), np.flatnonzero(q != 0)
        rising = q[dims] < 0  # the best end of a list is its low one
        seen = ids == own
        done, depth = 0, min(n, FIRST_DEPTH)
        scores, owners = best
        while True:
            if len(dims):
                met = np.concatenate([order[d, done:depth] if up else order[d, n - depth : n - done] for d, up in zip(dims, rising, strict=True)])
                bound = sum(q[d] * (lists[d, depth - 1] if up else lists[d, n - depth]) for d, up in zip(dims, rising, strict=True)) if n else 0
                fresh = np.zeros(n, bool)
                fresh[met] = True
                new = np.flatnonzero(fresh & ~seen)
                seen |= fresh
            else:
                new, bound, depth = np.flatnonzero(~seen), 0, n
            if len(new):
                self.scored += len(new)
                found = x[new] @ q
                if found.dtype == object:
                    found = np.array([min(max(v, _LONG[0]), _LONG[1]) for v in found.tolist()], object)
                scores, owners = np.concatenate((scores, found)), np.concatenate((owners, ids[new]))
                if len(scores) > self.k:
                    if scores.dtype != object:
                        floor = -np.partition(-scores, self.k - 1)[self.k - 1]
                        near = scores >= floor
                        scores, owners = scores[near], owners[near]
                    pick = np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], owners[j]))[: self.k])
                    scores, owners = scores[pick], owners[pick]
            if depth >= n or len(scores) >= self.k and min(scores) > bound:
                return scores, owners
            done, depth = depth, min(n, depth * 2)


def _answers(candidates: DataFrame, numbers: list[int], ids: np.ndarray, queries: list[np.ndarray], k: int) -> DataFrame:
    """Each task's k best rows for each query of one block."""
    shared = candidates.sparkSession.sparkContext.broadcast((numbers, ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, queries = shared.value
        by_size: dict[int, list[int]] = {}
        for i, q in enumerate(queries):
            by_size.setdefault(len(q), []).append(i)
        searches = {d: (own, Search(ids[own], np.array([queries[i] for i in own]).reshape(len(own), d), k)) for d, own in by_size.items()}
        for batch in batches:
            for found, x in _matrices(batch):
                if x.shape[1] in searches:
                    for at in range(0, len(found), BLOCK):
                        searches[x.shape[1]][1].add(found[at : at + BLOCK], x[at : at + BLOCK])
        for own, search in searches.values():
            rows = [(numbers[i], int(ids[i]), int(v), int(s)) for i, (scores, owners) in zip(own, search.best, strict=True) for s, v in zip(scores, owners, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["number", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "number long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query row, or all if there are fewer."""
    from .common import durable

    candidates = usable(vectors, vec_id, embedding)
    wanted = usable(queries, vec_id, embedding).distinct()
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))

    def answer(block: list, first: int) -> DataFrame:
        ids = np.array([r.vec_id for r in block], np.int64)
        own = [scaled(np.array(r.x, np.float64)) for r in block]
        found = _answers(candidates, list(range(first, first + len(block))), ids, own, k)
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    parts: list[DataFrame] = []
    block: list = []
    count = 0
    for row in wanted.toLocalIterator():
        if len(block) == QUERY_BLOCK:
            parts.append(durable(answer(block, count)))
            count, block = count + len(block), []
        block.append(row)
    parts.append(answer(block, count))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
