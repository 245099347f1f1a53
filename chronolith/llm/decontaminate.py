"""Benchmark decontamination with a broadcast hash set of benchmark n-grams.

Benchmark items are normalised into words and cut into windows of ``n``
words; an item of fewer words is one window. The windows go into a hash set
that is broadcast. Documents are scanned once: every word becomes its number
in the benchmark's vocabulary (0 if it has none), rolling hashes of all windows
are looked up, and each hit is verified word by word before it counts.

The broadcast is bounded: the benchmark is cut into blocks of at most
``BLOCK_BYTES`` of text and the scan is repeated for each block, carrying the
hits along in the row, so a benchmark of any size needs no shuffle of the
documents. Only one block is on the driver, and broadcast, at a time; between blocks the rows are written out.

Rows: null and empty texts have no words and no hits; null or wordless items
give no windows; null item ids are named ``null``; repeated rows are judged
alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, map_arrow, ragged, steps, text_bytes, written

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
WINDOW = 10
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Word bytes stay (letters lower-cased), all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Grams:
    """Windows of one benchmark block, in flat arrays.

    ``hashes[k]``: the sorted hashes of the different windows of k words, and the
    number of the first of them; window g has its words in ``words`` from
    ``first[g]`` on, and occurs in ``items[item_at[g]:item_at[g + 1]]``.
    """

    def __init__(self, given: list[tuple[str, str | None]], n: int):
        self.names = [name for name, _ in given]
        self.vocabulary: dict[bytes, int] = {}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in given]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate([*texts, np.zeros(0, np.int32)])
        ends = np.cumsum(sizes)
        self.hashes: dict[int, tuple[np.ndarray, int]] = {}
        firsts, items, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        groups = 0
        #: Hashes are tried anew with another salt until different windows differ in them.
        self.salt = 0
        each = {k: np.flatnonzero(np.minimum(sizes, n) == k) for k in np.unique(np.minimum(sizes, n)).tolist() if k}
        found = self._grouped(each, ends, sizes)
        while found is None:
            self.salt += 1
            found = self._grouped(each, ends, sizes)
        for k, (hashes, first, of, owner) in found.items():
            self.hashes[k] = hashes, groups
            both = np.unique(of * (len(given) + 1) + owner)  # an item once a window
            items.append((both % (len(given) + 1)).astype(np.int32))
            counts.append(np.bincount(both // (len(given) + 1), minlength=len(hashes)))
            firsts.append(first)
            groups += len(hashes)
        self.first, self.items = np.concatenate(firsts), np.concatenate(items)
        self.item_at = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)

    def _grouped(self, each: dict[int, np.ndarray], ends: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, ...]] | None:
        """For each length: hashes, a place of each different window, and window and item of all; None if different windows share a hash."""
        out = {}
        for k, own in each.items():
            count = sizes[own] - k + 1
            place = ragged(ends[own] - sizes[own], count)
            rolled = _roll(self.words, k, self.salt)[place]
            hashes, first, of = np.unique(rolled, return_index=True, return_inverse=True)
            if any((self.words[place + j] != self.words[place[first][of] + j]).any() for j in range(k)):
                return None
            out[k] = hashes, place[first], of, np.repeat(own, count)
        return out

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, window) of every window that occurs, verified word by word."""
        found = [(np.zeros(0, np.int64),) * 3]
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for k, (table, base) in self.hashes.items():
            if len(ids) < k:
                continue
            whole = np.flatnonzero(unknown[k:] == unknown[:-k])  # most windows hold an unknown word; only the others are looked up
            if not len(whole):
                continue
            rolled = _roll(ids, k, self.salt)[whole]
            slot = np.minimum(np.searchsorted(table, rolled), len(table) - 1)
            hit = table[slot] == rolled
            at, group = whole[hit], slot[hit] + base
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= ids[at + j] == self.words[self.first[group] + j]
            found.append((at[same], np.full(int(same.sum()), k), group[same]))
        at, k, group = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], k[order], group[order]


def _roll(ids: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    ids = ids.astype(np.uint64)
    out = np.full(len(ids) - k + 1, salt, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + ids[j : j + len(out)] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of items with a bounded size; the next is fetched when the one before is done with."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, row.text))
        size += len(row.text or "") * 2 + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HIT_NAMES = ["n_words", "starts", "ends", "items"]


def _scan(docs: DataFrame, shared, names: list[str], first: bool) -> DataFrame:
    """One pass for one block. ``docs``: ``names``, __text, and the hits so far unless ``first``."""
    schema = T.StructType([docs.schema[c] for c in [*names, "__text"]] + _HITS.fields)

    def run(batches):
        grams: Grams = shared.value
        get = grams.vocabulary.get
        for part in steps(batches):
            column = part.column(len(names))
            raw, at = text_bytes(column)
            texts, n_words, starts, ends, items = raw.tobytes().translate(_FOLD), [], [], [], []
            ids, own = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = texts[a:b].split()
                n_words.append(len(words))
                ids.extend(map(get, words))
                ids.append(None)  # a window never crosses documents
                starts.append([]), ends.append([]), own.append(set())
            numbers = np.fromiter((x or 0 for x in ids), np.int32, len(ids))
            begins = np.concatenate(([0], np.cumsum(np.array(n_words) + 1)))
            place, length, window = grams.hits(numbers)
            doc = np.searchsorted(begins, place, "right") - 1
            inner = place - begins[doc]
            for d, i, k in zip(doc.tolist(), inner.tolist(), length.tolist(), strict=True):
                starts[d].append(i)
                ends[d].append(i + k)
            pairs = np.unique(doc * len(grams.first) + window) if len(doc) else doc  # a window once a document
            for d, g in zip((pairs // max(1, len(grams.first))).tolist(), (pairs % max(1, len(grams.first))).tolist(), strict=True):
                own[d].update(grams.items[grams.item_at[g] : grams.item_at[g + 1]].tolist())
            own = [{grams.names[j] for j in x} for x in own]
            if not first:
                before = [part.column(len(names) + 1 + j).to_pylist() for j in range(4)]
                starts = [x + y for x, y in zip(before[1], starts, strict=True)]
                ends = [x + y for x, y in zip(before[2], ends, strict=True)]
                own = [set(x) | y for x, y in zip(before[3], own, strict=True)]
            items = [sorted(x) for x in own]
            new = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names) + 1)] + new, names=[*names, "__text", *_HIT_NAMES])

    return map_arrow(docs, run, schema)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep``, the text as __text, n_words, and the verified windows: word spans (starts, ends) and the ids of items."""
    names = carried(docs, keep, [*_HIT_NAMES, "__text"])
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    context, first, shared = docs.sparkSession.sparkContext, True, None
    for block in _blocks(benchmark, item, item_text):
        if shared is not None:  # one block is broadcast at a time: what the one before has found is written out
            out, first = written(out), False
            shared.destroy()
        shared = context.broadcast(Grams(block, n))
        out = _scan(out, shared, names, first)
    return _scan(out, context.broadcast(Grams([], n)), names, True) if shared is None else out


def _covered(starts: list[int], ends: list[int], n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.array(starts, np.int64), 1)
    np.add.at(step, np.array(ends, np.int64), -1)
    return np.cumsum(step)[:-1] > 0


def judge(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep``, n_words, n_hit (words inside windows), n_items, items_sha256 and contaminated for each document."""
    found = find(docs, benchmark, n, text, keep, item, item_text)
    names = [c for c in found.columns if c not in (*_HIT_NAMES, "__text")]
    names = carried(found, names, ["n_hit", "n_items", "items_sha256", "contaminated"])
    # Distinct covered words: windows are merged where they overlap, in order of their start.
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    n_hit = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(a["to"], x["starts"]))).alias("n"), F.greatest(a["to"], x["ends"]).alias("to")),
        lambda a: a["n"],
    )
    return found.select(
        *[F.col(f"`{c}`") for c in names],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows without any benchmark window, all columns as they were."""
    at = docs.columns.index(text)
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    found = find(docs.toDF(*inner), benchmark, n, inner[at], tuple(c for c in inner if c != inner[at]))
    fine = found.where(F.size("starts") == 0)
    return fine.select(*[F.col("__text" if i == at else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """``keep`` and the text without the words inside benchmark windows, and what separates those words."""
    found = find(docs, benchmark, n, text, keep)
    names = carried(found, [c for c in found.columns if c not in (*_HIT_NAMES, "__text")], [out])
    source = found.select(*[F.col(f"`{c}`") for c in names], "__text", "n_words", "starts", "ends")
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(out, T.StringType())])

    def cut(text: str | None, n_words: int, starts: list[int], ends: list[int]) -> str | None:
        if not starts:
            return text
        raw = (text or "").encode()
        letter = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        hit = _covered(starts, ends, n_words)
        gone = np.zeros(len(raw), bool)
        gone[ragged(begin[hit], (end - begin)[hit])] = True
        inner = np.flatnonzero(hit[:-1] & hit[1:])
        gone[ragged(end[inner], begin[inner + 1] - end[inner])] = True
        return np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()

    def run(batches):
        for part in steps(batches):
            k = len(names)
            new = [cut(*row) for row in zip(*[part.column(k + j).to_pylist() for j in range(4)], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(k)] + [pa.array(new, pa.string())], names=[*names, out])

    return map_arrow(source, run, schema)

