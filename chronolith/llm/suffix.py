"""Removal of repeated byte strings by content-chosen anchors; this isn't prefix doubling.

Sorting every byte position would shuffle many times the corpus, so positions
are thinned by content first. A window is a string of ``LENGTH`` = 200 bytes;
its anchor is the place of the smallest hash among its 40-byte strings, which
equal windows have in common. Successive windows with one anchor form a run.
Anchors are then ranked by strings of growing length, and at each length Spark
groups equal ranks and positions that have become unique are done with:

1. the 40 bytes at the anchor: an anchor whose string is unique has only unique windows;
2. the whole run (200 to some 360 bytes): if it occurs twice, all its windows are repeated;
3. the single windows, 200 bytes, of what is left: runs that share an anchor's
   40 bytes but not the whole run, mostly the ends of repeated passages.

Between the lengths a Bloom filter of at most 32 MB tells the next scan of the
texts which anchors may still matter; it only saves work, as its false
positives turn out unique later. Hash ranks are of 64 bits for anchors (a
collision costs work only) and 128 for runs; single windows are compared by
their bytes, in very large groups by a hash of 128 bits.

Equal texts are one text with a count. Anchors that more than ``HOT_RUNS``
different runs share are compared by a distributed aggregation of their
windows instead of in one task.

Rows: null and texts of fewer than 200 bytes lose nothing; repeated rows
repeat each other's strings and so lose all of them; ids may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, durable, hot, map_arrow, steps, text_bytes

LENGTH = 200
GRAM = 40
#: Bits of a filter block; a filter has at most MOST_BLOCKS of them, which is 32 MB.
BLOCK_BITS, MOST_BLOCKS = 1 << 16, 1 << 12
HOT_RUNS = 4096
#: Runs that a task remembers to have handed on.
SEEN = 100_000
_CHUNK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") | 1 for b in range(256)], np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _anchors(raw: np.ndarray, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a chunk the place of its anchor, and the hash of every gram."""
    n = len(raw) - gram + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers[0][: len(raw)], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:n]) * powers[1][:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    w = length - gram + 1
    low = np.full(-(-n // w) * w, ~np.uint64(0))
    low[:n] = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    table = low.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(raw) - length + 1
    return (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & _PLACE).astype(np.int64), h


def runs(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, windows after the first, offset of the anchor, gram hash), starts being places in ``raw``."""
    top = min(_CHUNK, len(raw)) + length
    powers = _powers(top, _BASE), _powers(top, pow(_BASE, -1, 1 << 64))
    for begin in range(0, max(0, len(raw) - length + 1), _CHUNK):
        part = raw[begin : begin + _CHUNK + length - 1]
        anchor, h = _anchors(part, length, gram, powers)
        p = np.arange(begin, begin + len(anchor))
        doc = np.searchsorted(at, p, "right") - 1
        whole = p + length <= at[doc + 1]
        p, doc, anchor = p[whole], doc[whole], anchor[whole]
        if not len(p):
            continue
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(p)])) - 1
        yield doc[first], p[first], p[last] - p[first], anchor[first] + begin - p[first], h[anchor[first]].view(np.int64)


class Filter:
    """A Bloom filter in blocks; three bits for each gram, all in the block that its low bits name."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks = blocks
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8) if bits is None else bits

    @staticmethod
    def places(grams: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
        g = grams.view(np.uint64)
        block = (g % np.uint64(blocks)).astype(np.int64)
        return block, [((g >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in (14, 31, 48)]

    def has(self, grams: np.ndarray) -> np.ndarray:
        block, inner = self.places(grams, self.blocks)
        out = np.ones(len(grams), bool)
        for i in inner:
            place = block * BLOCK_BITS + i
            out &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0
        return out


def build_filter(grams: DataFrame) -> Filter | None:
    """Of a column ``gram``; None if there are none. Each block is made by one task; the driver gets 32 MB at most."""
    n = grams.count()
    if not n:
        return None
    blocks = min(MOST_BLOCKS, 1 << max(0, (n * 12 // BLOCK_BITS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(BLOCK_BITS, bool))
        for batch in batches:
            g = batch.column(0).to_numpy()
            block, inner = Filter.places(g, blocks)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0))) if len(order) else order
            for rows in np.split(order, cut[1:]):
                if len(rows):
                    for i in inner:
                        own[int(block[rows[0]])][i[rows]] = True
        if own:
            packed = [np.packbits(x, bitorder="little").tobytes() for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])

    number = F.expr(f"cast(pmod(pmod(gram, {blocks}) + {blocks}, {blocks}) as int)")  # blocks is a power of two: as for the unsigned gram
    rows = grams.select("gram").repartition(min(64, blocks), number).mapInArrow(run, "block long, bits binary").collect()
    out = Filter(blocks)
    for row in rows:
        out.bits[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _keyed(docs: DataFrame, text: str) -> tuple[Column, Column, Column]:
    """The text, and 128 bits that stand for it."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return t, F.xxhash64(t), F.xxhash64(F.lit(7), t)


def _scan_grams(source: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for part in steps(batches, limit=1 << 20):
            raw, at = text_bytes(part.column(0))
            found = [r[4] for r in runs(raw, at, length, gram)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["gram"])

    return source.select("__text").mapInArrow(run, "gram long")


def _scan_runs(source: DataFrame, length: int, gram: int, wanted, many=None, content: bool = False) -> DataFrame:
    """Runs whose gram is in the filter: where they are, or with ``content`` what they hold, once a task (while it remembers)."""
    schema = "gram long, run long, off int, ctx binary, hot boolean" if content else "k1 long, k2 long, s long, n int, gram long, run long"

    def run(batches):
        filter_, hot_filter, seen = wanted.value, many.value if many else None, set()
        for part in steps(batches, limit=1 << 20):
            raw, at = text_bytes(part.column(2))
            view = raw.tobytes()
            if len(seen) > SEEN:
                seen.clear()
            k1, k2 = part.column(0).to_numpy(), part.column(1).to_numpy()
            for doc, start, n, off, g in runs(raw, at, length, gram):
                keep = np.flatnonzero(filter_.has(g))
                if not len(keep):
                    continue
                doc, start, n, off, g = doc[keep], start[keep], n[keep], off[keep], g[keep]
                strings = [view[a : a + m + length] for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                names = np.fromiter((xxhash.xxh3_64_intdigest(x, o) for x, o in zip(strings, off.tolist(), strict=True)), np.uint64, len(strings)).view(np.int64)
                if content:
                    pairs = list(zip(g.tolist(), names.tolist(), strict=True))
                    once = [i for i, pair in enumerate(pairs) if pair not in seen and not seen.add(pair)]
                    if not once:
                        continue
                    arrays = [pa.array(g[once]), pa.array(names[once]), pa.array(off[once], pa.int32()), pa.array([strings[i] for i in once], pa.binary()), pa.array(hot_filter.has(g[once]) if hot_filter else np.zeros(len(once), bool))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["gram", "run", "off", "ctx", "hot"])
                else:
                    arrays = [pa.array(k1[doc]), pa.array(k2[doc]), pa.array(start - at[doc]), pa.array(n, pa.int32()), pa.array(g), pa.array(names)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "s", "n", "gram", "run"])

    return source.select("k1", "k2", "__text").mapInArrow(run, schema)


def _spans_of(flags: list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(flags, np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _group_windows(group: dict[int, tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """(run, first, last window) that another run of the same anchor string has too."""
    if len(group) < 2:
        return
    seen: dict[tuple[int, bytes], int] = {}
    for off, ctx in group.values():
        for i in range(len(ctx) - length + 1):
            key = (i - off, ctx[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    for run, (off, ctx) in group.items():
        for a, b in _spans_of([seen[i - off, ctx[i : i + length]] > 1 for i in range(len(ctx) - length + 1)]):
            yield run, a, b


def _compare(length: int):
    """Groups of rows sorted by gram; a group's different runs are bounded by HOT_RUNS, up to false positives."""

    def run(batches):
        now, group, out = None, {}, []

        def close():
            out.extend((now, *x) for x in _group_windows(group, length))

        for batch in batches:
            for g, name, off, ctx in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if g != now:
                    close()
                    now, group = g, {}
                group[name] = (off, ctx)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


_NAMES, _KINDS = ["gram", "run", "first", "last"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_SPANS = "gram long, run long, first int, last int"


def _hot_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors that very many runs share: windows are counted by an aggregation."""
    once = rows.groupBy("gram", "run").agg(F.first("off").alias("off"), F.first("ctx").alias("ctx"))

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                g, name, off, ctx = (batch.column(i)[j].as_py() for i in range(4))
                n = len(ctx) - length + 1
                digests = [xxhash.xxh3_128_digest(ctx[i : i + length], i - off + (1 << 32)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())], names=["gram", "run", "first", "window"])

    windows = durable(once.mapInArrow(run, "gram long, run long, first int, window binary"))
    repeated = windows.groupBy("gram", "window").count().where("count > 1").select("gram", "window")
    return windows.join(repeated, ["gram", "window"]).select("gram", "run", "first", F.col("first").alias("last"))


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame | None:
    """(k1, k2, spans, copies): byte ranges to remove of each text that loses any, and its number of rows; None if none can."""
    if not 0 < gram <= length:
        raise ValueError("a window has at least the bytes of an anchor's string")
    t, k1, k2 = _keyed(docs, text)
    source = docs.select(k1.alias("k1"), k2.alias("k2"), t.alias("__text"))
    context = docs.sparkSession.sparkContext
    grams = durable(_scan_grams(source, length, gram).groupBy("gram").count().where("count > 1").select("gram"))
    wanted = build_filter(grams)
    if wanted is None:
        return None
    places = durable(_scan_runs(source, length, gram, context.broadcast(wanted)).groupBy("k1", "k2", "s", "n", "gram", "run").count())
    found = durable(places.groupBy("gram", "run").agg(F.sum("count").alias("c")))
    shared = durable(found.groupBy("gram").agg(F.count(F.lit(1)).alias("runs"), F.min("c").alias("least")).where("runs > 1 and least = 1"))
    # Runs of very many texts, 1,024 of them at most, are met without moving those texts' rows.
    hot_runs = found.where(hot("c", found.agg(F.sum("c")).first()[0])).select("gram", "run")
    whole = _beside(places, found.where("c > 1").select("gram", "run"), hot_runs).select("k1", "k2", "count", F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + length).alias("b")).alias("span"))
    open_ = build_filter(shared)
    parts = whole
    if open_ is not None:
        many = build_filter(shared.where(F.col("runs") > HOT_RUNS))
        rows = _scan_runs(source, length, gram, context.broadcast(open_), context.broadcast(many) if many else None, content=True)
        if many:
            rows = durable(rows)
        cold = rows.where(~F.col("hot")).select("gram", "run", "off", "ctx").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(length), _SPANS)
        windows = cold.unionByName(_hot_windows(rows.where("hot"), length)) if many else cold
        some = _beside(places, durable(windows), hot_runs).select("k1", "k2", "count", F.struct((F.col("s") + F.col("first")).alias("a"), (F.col("s") + F.col("last") + length).alias("b")).alias("span"))
        parts = parts.unionByName(some)
    return parts.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.max("count").alias("copies"))


def _beside(places: DataFrame, sides: DataFrame, apart: DataFrame) -> DataFrame:
    keys = ["gram", "run"]
    cold = places.join(F.broadcast(apart), keys, "left_anti").join(sides.join(F.broadcast(apart), keys, "left_anti"), keys)
    return cold.unionByName(places.join(F.broadcast(sides.join(F.broadcast(apart), keys, "left_semi")), keys))


def _merged(found: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for x in found or []:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return out


def _with_spans(docs: DataFrame, text: str, keep: list[str], length: int, gram: int) -> DataFrame:
    found = spans(docs, text, length, gram)
    t, k1, k2 = _keyed(docs, text)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("__text"), k1.alias("__k1"), k2.alias("__k2"))
    empty = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    if found is None:
        return rows.withColumn("__spans", empty).drop("__k1", "__k2")
    found = durable(found.toDF("__k1", "__k2", "__spans", "__copies"))
    apart = hot("__copies", found.agg(F.sum("__copies")).first()[0])
    near = rows.join(F.broadcast(found.where(apart).drop("__copies")), ["__k1", "__k2"], "left")
    others = near.where("__spans is null").drop("__spans").join(found.where(~apart).drop("__copies"), ["__k1", "__k2"], "left")
    return near.where("__spans is not null").unionByName(others).drop("__k1", "__k2")


def _cut(raw: bytes, found: list[list[int]]) -> bytes:
    parts, to = [], 0
    for a, b in found:
        parts.append(raw[to:a])
        to = b
    return b"".join([*parts, raw[to:]])


def digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    names = carried(docs, keep, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    rows = _with_spans(docs, text, names, length, gram)
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for part in steps(batches):
            k = len(names)
            raw, at = text_bytes(part.column(k))
            view, out = raw.tobytes(), []
            for a, b, found in zip(at[:-1].tolist(), at[1:].tolist(), part.column(k + 1).to_pylist(), strict=True):
                gone = _merged(found)
                out.append((b - a, sum(y - x for x, y in gone), len(gone), hashlib.sha256(_cut(view[a:b], gone)).hexdigest()))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(k)] + arrays, names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(rows, run, schema)


def remove(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "kept", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``keep`` and the remaining bytes (binary, as a cut may fall inside a character)."""
    names = carried(docs, keep, [out])
    rows = _with_spans(docs, text, names, length, gram)
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        for part in steps(batches):
            k = len(names)
            raw, at = text_bytes(part.column(k))
            view = raw.tobytes()
            new = [_cut(view[a:b], _merged(f)) for a, b, f in zip(at[:-1].tolist(), at[1:].tolist(), part.column(k + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(k)] + [pa.array(new, pa.binary())], names=[*names, out])

    return map_arrow(rows, run, schema)
