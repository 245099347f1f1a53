"""Binary forms of samples, and the SQL functions that use them.

``TSI1`` is a batch of (series, time, value) records; ``STB1`` a compressed block
of one series: times as differences of differences and values as XOR with the
one before, both in variable-length bytes, or plain values where that is no larger.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
BATCH, BLOCK, VERSION, RECORD = b"TSI1", b"STB1", 1, 24
BATCH_HEAD, BLOCK_HEAD = struct.Struct("<4sHHII"), struct.Struct("<4sBBBBIqIII")
RAW, XOR = 0, 1
MOST_POINTS, MOST_BATCH = 1_048_576, 10_000_000
ENGINE_VERSION = "0.1.0-dev"
_MASK = (1 << 64) - 1


class CorruptBlock(ValueError):
    pass


def encode_batch(rows: list[tuple[int, int, float]]) -> bytes:
    if len(rows) > MOST_POINTS:
        raise ValueError("too many samples for a batch")
    return BATCH_HEAD.pack(BATCH, VERSION, RECORD, len(rows), 0) + b"".join(struct.pack("<qqd", *r) for r in rows)


def decode_batch(data: bytes) -> list[tuple[int, int, float]]:
    if len(data) < BATCH_HEAD.size:
        raise CorruptBlock("batch is too short")
    magic, version, record, count, flags = BATCH_HEAD.unpack_from(data)
    if (magic, version, record, flags) != (BATCH, VERSION, RECORD, 0) or count > MOST_BATCH or len(data) != BATCH_HEAD.size + count * RECORD:
        raise CorruptBlock("bad batch header")
    return list(struct.iter_unpack("<qqd", data[BATCH_HEAD.size :]))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varints(data: bytes, count: int) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        if n > _MASK or shift > 63:
            raise CorruptBlock("number too long")
        if b & 128:
            shift += 7
        else:
            if shift and not b:
                raise CorruptBlock("number isn't minimal")
            out.append(n)
            n = shift = 0
    if shift or len(out) != count:
        raise CorruptBlock("wrong number of numbers")
    return out


def encode_block(times: list[int], values: list[float]) -> bytes:
    n = len(times)
    if not 0 < n <= MOST_POINTS or n != len(values):
        raise ValueError("a block has 1 to 1048576 points")
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("times must rise strictly")
    deltas = [b - a for a, b in zip(times, times[1:], strict=False)]
    ts = b"".join([_varint(deltas[0])] + [_varint((d << 1 ^ d >> 127) & _MASK) for d in np.diff(np.array(deltas, object))]) if deltas else b""
    raw = struct.pack(f"<{n}d", *values)
    bits = struct.unpack(f"<{n}Q", raw)
    packed = struct.pack("<Q", bits[0]) + b"".join(_varint(a ^ b) for a, b in zip(bits, bits[1:], strict=False))
    codec, body = (XOR, packed) if len(packed) < len(raw) else (RAW, raw)
    head = lambda crc: BLOCK_HEAD.pack(BLOCK, VERSION, 1, codec, 0, n, times[0], len(ts), len(body), crc)
    return head(zlib.crc32(head(0) + ts + body)) + ts + body


def decode_block(data: bytes) -> tuple[list[int], list[float]]:
    if len(data) < BLOCK_HEAD.size:
        raise CorruptBlock("block is too short")
    magic, version, time_codec, codec, zero, n, first, ts_size, body_size, crc = BLOCK_HEAD.unpack_from(data)
    if (magic, version, time_codec, zero) != (BLOCK, VERSION, 1, 0) or codec not in (RAW, XOR) or not 0 < n <= MOST_POINTS or len(data) != BLOCK_HEAD.size + ts_size + body_size:
        raise CorruptBlock("bad block header")
    if zlib.crc32(data[:28] + b"\0\0\0\0" + data[32:]) != crc:
        raise CorruptBlock("checksum differs")
    ts, body = data[32 : 32 + ts_size], data[32 + ts_size :]
    numbers = _varints(ts, n - 1)
    times, delta = [first], 0
    for i, x in enumerate(numbers):
        delta = x if i == 0 else delta + (x >> 1 ^ -(x & 1))
        if delta <= 0:
            raise CorruptBlock("times must rise strictly")
        times.append(times[-1] + delta)
    if codec == RAW:
        if body_size != 8 * n:
            raise CorruptBlock("wrong number of values")
        return times, list(struct.unpack(f"<{n}d", body))
    if body_size < 8:
        raise CorruptBlock("wrong number of values")
    bits = [struct.unpack_from("<Q", body)[0]]
    for x in _varints(body[8:], n - 1):
        bits.append(bits[-1] ^ x)
    return times, list(struct.unpack(f"<{n}d", struct.pack(f"<{n}Q", *bits)))


POINTS = T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())]))


def pack(rows: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", points: int = 2048) -> DataFrame:
    """Blocks of at most ``points`` samples of each key, by six-hour buckets: keys, bucket_start_ms, chunk_no, min_ts, max_ts, sample_count, payload."""
    from pyspark.sql import Window

    bucket = (F.col(ts) - F.pmod(F.col(ts), F.lit(21_600_000))).alias("bucket_start_ms")
    numbered = rows.select(*keys, F.col(ts).alias("__t"), F.col(value).alias("__v"), bucket)
    place = F.row_number().over(Window.partitionBy(*keys, "bucket_start_ms").orderBy("__t")) - 1
    chunks = numbered.withColumn("chunk_no", F.floor(place / points).cast("int")).groupBy(*keys, "bucket_start_ms", "chunk_no")
    each = chunks.agg(F.min("__t").alias("min_ts"), F.max("__t").alias("max_ts"), F.count(F.lit(1)).alias("sample_count"), F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))).alias("p"))
    return each.withColumn("payload", pack_points("p")).drop("p")


@F.pandas_udf(T.BinaryType())
def pack_points(points: pd.Series) -> pd.Series:
    return points.map(lambda p: encode_block([x["t"] for x in p], [x["v"] for x in p]) if p is not None and len(p) else None)


@F.pandas_udf(POINTS)
def unpack_points(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: [{"t": t, "v": v} for t, v in zip(*decode_block(bytes(b)), strict=True)] if b is not None else None)


def unpack(blocks: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, ts and value of every sample."""
    return blocks.select(*keys, F.explode(unpack_points(payload)).alias("p")).select(*keys, F.col("p.t").alias("ts"), F.col("p.v").alias("value"))


class BatchRows:
    """Rows of a ``TSI1`` blob."""

    def eval(self, batch: bytes) -> Iterator[tuple[int, int, float]]:
        if batch is None:
            raise ValueError("tsdb_batch needs a batch")
        yield from decode_batch(bytes(batch))


def register(spark: SparkSession) -> None:
    """tsdb_version(), the aggregate tsdb_pack(ts, value) and the table function tsdb_batch(blob) for SQL."""
    spark.udf.register("tsdb_version", lambda: ENGINE_VERSION, T.StringType())
    spark.udf.register("tsdb_pack", _pack_grouped())
    spark.udtf.register("tsdb_batch", F.udtf(BatchRows, returnType="series_id long, ts long, value double"))


def _pack_grouped():
    def tsdb_pack(ts: pd.Series, value: pd.Series) -> bytes:
        order = np.argsort(ts.to_numpy(), kind="stable")
        if ts.isna().any() or value.isna().any():
            raise ValueError("tsdb_pack needs whole times, and values that are neither null nor NaN")
        return encode_block([int(t) for t in ts.to_numpy()[order]], value.to_numpy()[order].tolist()) if len(ts) else None

    tsdb_pack.__annotations__ = {"ts": pd.Series, "value": pd.Series, "return": bytes}  # annotations are text in this module
    return F.pandas_udf(tsdb_pack, "binary")
