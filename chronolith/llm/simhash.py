"""SimHash near-dedup with an inverted index of byte positions and count filtering.

A text's fingerprint has a bit set where over half of the hashes of its
shingles have it. Two fingerprints within ``DISTANCE`` = 4 bits share at least
4 of their 8 bytes in place, and so at least 3 of the first 7. The index holds
each distinct fingerprint under its 35 choices of 3 positional bytes; in a
posting list the shared positional bytes are tallied for each pair, pairs with
4 or more are kept, and their bits are compared. Lists of single bytes, 256 to
a position, would make the pairs grow with the square of the input.

Equal texts collapse into one fingerprint before the index, so copies cost
nothing there. A posting list gives the edges of a spanning forest, never all
its pairs. Lists longer than ``LONG_LIST`` aren't compared in one task: their
fingerprints are indexed again under their 70 choices of 4 of all 8 bytes, and tallied there. Those that
share even 4 bytes with over ``LONG_LIST`` others, which no more bytes could
part for certain, are spread under every value within 2 bits, and two of them are
within 4 bits exactly if they meet under one (a value has at most 2,081
fingerprints within 2 bits, so no meeting is large).

Rows: null and empty texts have fingerprint zero, which links like any other.
Repeated rows and ids are fine. A null id is never the smallest; a component
without any id has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, durable, map_texts, split_join, text_bytes
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SHARED = 8 - DISTANCE
#: Distinct fingerprints of a posting list that one task compares.
LONG_LIST = 20_000
_STEP = 1 << 17


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints as signed numbers."""
    raw, at = text_bytes(column)
    lower, digest = raw.tobytes().lower(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(at) - 1, np.int64)
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        words = lower[a:b].split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(joined, SEED))
            counts[d] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - shingle])).tolist()
        hashes += [digest(joined[x:y], SEED) for x, y in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts[d] = n - shingle + 1
    tally = np.zeros((len(counts), 64), np.int64)
    flat = np.array(hashes, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for begin in range(0, len(flat), _STEP):
        bits = np.unpackbits(flat[begin : begin + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[begin : begin + _STEP]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        tally[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    over = (tally * 2 > counts[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).reshape(-1)


def mark(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """``keep`` and the fingerprint as a long."""

    def make():
        return lambda column: [pa.array(fingerprints(column, shingle), pa.int64())]

    return map_texts(docs, text, keep, [T.StructField(out, T.LongType())], make)


def _keys(fp: Column, positions: int = 7, choose: int = 3) -> Column:
    """The index keys, 35 of 3 bytes or 70 of 4: the choice of positions, then the bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(positions)]
    keys = []
    for n, chosen in enumerate(combinations(range(positions), choose)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = key * F.lit(256) + byte[i]
        keys.append(key)
    return F.array(*keys)


def _near(one: np.uint64 | np.ndarray, others: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes shared, then the bits."""
    differ = one ^ others
    out = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= SHARED
    out[out] = np.bitwise_count(differ[out]) <= DISTANCE
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is connected among the fingerprints of a list: at most one less than there are."""
    edges, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _near(one, left)
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                edges.extend((int(one), int(x)) for x in found.view(np.int64))
    return [(int(np.uint64(a).view(np.int64)), b) for a, b in edges]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole runs of equal keys from batches that are sorted by key."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy()))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield keys[:whole], fps[:whole]
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield keys, fps


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(dict.fromkeys(pairs))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, fps in _lists(batches):
        cut = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        a, b = fps[two], fps[two + 1]
        near = _near(a.view(np.uint64), b.view(np.uint64))
        found = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += forest(fps[at : at + n].view(np.uint64))
        if found:
            yield _edges(found)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate(([np.uint64(0)], one, one[i] | one[j]))
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 256):
            own = fps[at : at + 256]
            values = (own.view(np.uint64)[:, None] ^ masks).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(own, len(masks)))], names=["key", "fp"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, fps in _lists(batches):
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        head = fps[np.flatnonzero(first)[np.cumsum(first) - 1]]
        other = head != fps
        if other.any():
            pairs = np.unique(np.column_stack((head[other], fps[other])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(distinct: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): edges that connect what links of at most ``DISTANCE`` bits connect. ``distinct``: fp, each once.

    Fingerprints of lists that are too long are indexed again by more bytes, which
    linking pairs share too: 4 of all 8. Only what still has a long list there meets by values.
    """
    edges = []
    for positions, choose in ((7, 3), (8, 4)):
        keyed = distinct.select(F.explode(_keys(F.col("fp"), positions, choose)).alias("key"), "fp")
        long_keys = durable(keyed.groupBy("key").count().where(F.col("count") > long_list).select("key"))
        none = long_keys.isEmpty()
        short = keyed if none else keyed.join(long_keys, "key", "left_anti")
        edges.append(short.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "a long, b long"))
        if none:
            break
        distinct = durable(keyed.join(long_keys, "key", "left_semi").select("fp").distinct())
    else:
        edges.append(distinct.mapInArrow(_spread, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long"))
    return reduce(DataFrame.unionByName, edges)


def groups(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), doc_id: str = "doc_id", shingle: int = SHINGLE, long_list: int = LONG_LIST) -> DataFrame:
    """The id, ``keep``, fp (long), root (its component's smallest fp) and component_id: the smallest id that is reachable over links, its own included."""
    names = carried(docs, [doc_id, *keep], ["fp", "root", "component_id"])
    marks = durable(mark(docs, text, tuple(names), shingle))
    distinct = durable(marks.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("first"), F.count(F.lit(1)).alias("n")))
    found = durable(components(links(distinct.select("fp"), long_list)))
    least = found.join(distinct, found["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = found.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"), "n")
    return split_join(marks, durable(named), "fp", "n").select(*[F.col(f"`{c}`") for c in names], "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint in hex, and component_id for each row."""
    return groups(docs, text, (), doc_id).select(F.col(f"`{doc_id}`"), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the table, one of each component: that of its smallest id.

    A component without any id keeps one row too. Of its rows that repeat the
    smallest id one stays, that of the least hash of its text.
    """
    digest = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"), digest.alias("__digest"))
    found = durable(groups(plain, "__t", ("__digest",), "__id"))
    kept = found.where("__id = component_id").groupBy("__id", "root").agg(F.min("__digest").alias("__own")).select("__id", "__own")
    rows = docs.join(kept, (docs[f"`{doc_id}`"] == kept["__id"]) & (digest == kept["__own"]), "left_semi")
    if not found.where("__id = component_id").groupBy("__id", "__digest").count().where("count > 1").limit(1).isEmpty():
        rows = _one_of_each(rows, text, F.col(f"`{doc_id}`"), digest)
    if found.where("component_id is null").limit(1).isEmpty():
        return rows
    return rows.unionByName(_without_ids(docs, text, doc_id))


def _one_of_each(rows: DataFrame, text: str, *keys: Column) -> DataFrame:
    """One row for each key, that of the least text; combined before the shuffle."""
    whole = F.struct(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rows.columns if c != text])
    best = rows.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min(whole).alias("__row"))
    return best.select(*[F.col("__row").getField(c).alias(c) for c in rows.columns])


def _without_ids(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Of the rows without an id, one for each component that has no id at all."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    names = durable(docs.select(digest.alias("__digest"), F.col(f"`{text}`").alias("__t"), F.col(f"`{doc_id}`").alias("__given")).groupBy("__digest").agg(F.min("__t").alias("__t"), F.max(F.col("__given").isNotNull()).alias("__has")))
    numbered = durable(names.select("__digest", "__t", "__has", F.xxhash64("__digest").alias("__number")))
    grouped = groups(numbered, "__t", ("__has",), "__number").groupBy("component_id").agg(F.max("__has").alias("has"))
    wanted = numbered.join(grouped.where("not has"), numbered["__number"] == grouped["component_id"]).select("__digest")
    rows = docs.where(F.col(f"`{doc_id}`").isNull()).withColumn("__digest", digest).join(wanted, "__digest")
    return _one_of_each(rows.withColumnRenamed(doc_id, "__null_id"), text, F.col("__digest")).select(*[F.col("__null_id").alias(c) if c == doc_id else F.col(f"`{c}`") for c in docs.columns])
