"""Helpers shared by the training-data operators.

Conventions of every operator here:

* Only the id column, the text column and the columns named in ``keep`` are
  read, so further columns of the input never reach an operator. A kept column
  whose name (compared without case) equals one that the operator produces
  gives way to the produced one.
* Null text counts as empty text. Ids are carried, never interpreted, so null
  or repeated ids are fine: a row in gives a row out.
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step works on; longer single texts form a step of their own.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, keep: Sequence[str], produced: Iterable[str]) -> list[str]:
    """The kept columns whose names the operator doesn't produce itself."""
    taken = {c.lower() for c in produced}
    return [c for c in dict.fromkeys(keep) if c.lower() not in taken]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n+1 offsets into them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterable[pa.RecordBatch], text: str = "__text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``limit`` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, min(end, n) - begin)
            begin = min(end, n)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` where columns may have any name: the plain one can't resolve names with dots."""
    return df.toDF(*[c if c.isidentifier() else f"__in{i}" for i, c in enumerate(df.columns)]).mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    limit: int = STEP_BYTES,
) -> DataFrame:
    """One output row for each row: the kept columns, then ``fields`` computed from the text.

    ``make`` runs once a task and returns the function from a text array to
    the new arrays. A narrow map: no shuffle, and a lost task is simply run again.
    """
    names = carried(df, keep, [f.name for f in fields])
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in names] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in steps(batches, limit=limit):
            new = function(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + new, names=names + [f.name for f in fields])

    return map_arrow(source, run, schema)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder that all executors share; cuts the lineage.

    A folder is set only where the session has none, as in tests.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where there is none, only a local session gets a folder of its own, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(place)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, but as a compressed Parquet table in that folder."""
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Share of all rows from which a key is joined apart from the others; so there are at most as many such keys.
HOT_SHARE = 1024
#: Rows that a key must have at least for that.
HOT_LEAST = 1000


def hot(count: str, total: int | None) -> Column:
    """Whether a key has so many of all rows that it is joined apart; that holds for HOT_SHARE keys at most."""
    return (F.col(count) * HOT_SHARE > F.lit(total or 0)) & (F.col(count) > HOT_LEAST)


def split_join(rows: DataFrame, sides: DataFrame, keys: str | list[str], count: str) -> DataFrame:
    """``rows`` joined with their one row of ``sides``, whose column ``count`` says how many rows the key has.

    Rows of a hot key stay where they are: the sides of such keys, 1,024 at
    most by construction, are broadcast. All others are shuffled. ``sides`` should be a written table.
    """
    keys = [keys] if isinstance(keys, str) else keys
    apart = hot(count, sides.agg(F.sum(count)).first()[0])
    some = F.broadcast(sides.where(apart))
    cold = rows.join(F.broadcast(sides.where(apart).select(*keys)), keys, "left_anti").join(sides.where(~apart), keys)
    return cold.unionByName(rows.join(some, keys))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, … for each pair, all in a row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
