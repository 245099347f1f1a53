"""Prefix doubling in its plain form, over every byte position; the measure of the anchors in ``suffix``.

Positions start with the rank of their first bytes. Spark sorts the pairs (rank of a
position, rank of the position that far on), equal pairs get one new rank, and the
length known doubles until it is that of a window; positions whose rank is
unique leave. Every round shuffles all positions left, some 28 bytes for each byte of text,
so this is for small tables and for checking.

Rows: as in ``suffix``; repeated rows repeat each other's strings, null has no bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, steps, text_bytes

LENGTH, FIRST = 200, 25


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """(row, at): each place where a window begins that also begins elsewhere. ``row``: the number of the row as read, from a written table."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    if length % first or (length // first) & (length // first - 1):
        raise ValueError("a window has the first length times a power of two")

    def positions(batches):
        for part in steps(batches, limit=1 << 18):
            raw, at = text_bytes(part.column(1))
            view, n = raw.tobytes(), np.maximum(np.diff(at) - first + 1, 0)
            where = np.concatenate([np.arange(k) for k in n.tolist()])
            names = [xxhash.xxh3_64_intdigest(view[a + i : a + i + first]) for a, k in zip(at[:-1].tolist(), n.tolist(), strict=True) for i in range(k)]
            row = np.repeat(part.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(where), pa.array(np.array(names, np.uint64).view(np.int64))], names=["row", "at", "rank"])

    def ranked(batches):
        """New ranks for pairs that are sorted; a pair's rows are together in one partition."""
        from pyspark import TaskContext

        now, rank = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            r, s = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
            if len(r):
                new[0] = (r[0], s[0]) != now
                ranks = rank + np.cumsum(new)
                now, rank = (r[-1], s[-1]), int(ranks[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranks)], names=["row", "at", "rank"])

    left = source.mapInArrow(positions, "row long, at long, rank long")
    known = first
    while True:
        left = durable(left)
        left = left.join(left.groupBy("rank").count().where("count > 1").select("rank"), "rank", "left_semi")
        if known == length:
            return left.select("row", "at")
        ahead = left.select("row", (F.col("at") - known).alias("at"), F.col("rank").alias("next"))
        pairs = left.join(ahead, ["row", "at"]).select("row", "at", "rank", "next")
        left = pairs.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").mapInArrow(ranked, "row long, at long, rank long")
        known *= 2
