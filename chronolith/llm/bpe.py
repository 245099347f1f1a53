"""Byte-level BPE encoding and decoding.

Texts are cut by the split pattern and each distinct piece is encoded once a
step. Pieces of similar length form one padded matrix of token ids; in every
round each row merges its leftmost pair of the smallest rank, found by a hashed
pair table, and the row is compacted by one place. Rows without a mergeable
pair leave the matrix. A piece of over ``LONG`` bytes (a piece has no bound) is a
matrix by itself: its row is folded into blocks, and a round compacts only the
block of its merge, as one row of all its bytes would take quadratic time. That is the order of merges of the usual rank-based
encoders, so the ids are the same.

Rows: null and empty texts give no ids and decode to no bytes; repeated rows
give repeated results. The vocabulary is read on the driver and broadcast: its size is
bounded by the rank file (about 50,000 entries), not by the data.
"""

from __future__ import annotations

import base64
import hashlib
from re import compile as re_compile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, map_texts, ragged

#: Bytes of the longest rows that share a matrix; a longer piece has a matrix of its own, folded into blocks.
LONG = 256
#: Places of such a block.
BLOCK = 1024
#: Bytes of remembered units of a task, by estimate, and of one unit without its ids.
REMEMBER, UNIT = 16 << 20, 160
_SPACE_SPACE = re_compile(r" \s")
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks as flat arrays: token bytes, and a hash table from id pairs to the merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        words = [b"%d," % i for i in range(n)]
        self.word_at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        mask = (1 << self.bits) - 1
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks_of = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        while len(keys):  # open addressing: a free place goes to one key of those that ask for it
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            put = self.keys[slot] == keys
            self.values[slot[put]] = ranks_of[put]
            keys, ranks_of, slot = keys[~put], ranks_of[~put], (slot[~put] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: int, right: int) -> int:
        """The same for one pair."""
        key = left << 20 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (found := self.keys[slot]) >= 0:
            if found == key:
                return int(self.values[slot])
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of each merged pair; NONE where the two don't merge."""
        keys = left << 20 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        mask = (1 << self.bits) - 1
        while len(open_):
            slot.flat[open_] = (slot.flat[open_] + 1) & mask
            found = self.keys[slot.flat[open_]]
            hit = found == keys.flat[open_]
            out.flat[open_[hit]] = self.values[slot.flat[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _merge_matrix(vocabulary: Vocabulary, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of similar length: flat, in the order of the pieces, and the count for each."""
    width, rows = int(lengths.max()), len(lengths)
    place = np.minimum(starts[:, None] + np.arange(width), len(raw) - 1)
    ids = np.where(np.arange(width) < lengths[:, None], vocabulary.byte_id[raw[place]], -1)
    done = np.full((rows, width), -1, np.int64)
    count = lengths.copy()
    live = np.arange(rows)
    ranks = np.full((rows, max(1, width - 1)), NONE)
    if width > 1:
        both = ids[:, 1:] >= 0
        ranks[both] = vocabulary.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
    while True:
        at = ranks.argmin(1)
        best = ranks[np.arange(len(live)), at]
        over = best == NONE
        if over.any():
            done[live[over], : ids.shape[1]] = ids[over]
            keep = ~over
            live, ids, ranks, at, best = live[keep], ids[keep], ranks[keep], at[keep], best[keep]
        if not len(live):
            break
        row = np.arange(len(live))
        ids[row, at] = best
        columns = np.arange(ids.shape[1] - 1)
        after = columns > at[:, None]
        ids = np.where(after, ids[:, 1:], ids[:, :-1])
        count[live] -= 1
        columns = columns[:-1]
        ranks = np.where(columns > at[:, None], ranks[:, 1:], ranks[:, :-1]) if ids.shape[1] > 1 else np.full((len(live), 1), NONE)
        for side in (-1, 0):  # only the two pairs beside the merged token are new
            pair = at + side
            fits = (pair >= 0) & (pair < ids.shape[1] - 1)
            r, p = row[fits], pair[fits]
            if len(r):
                left, right = ids[r, p], ids[r, p + 1]
                new = np.full(len(r), NONE)
                real = right >= 0
                new[real] = vocabulary.pair_ranks(left[real], right[real])
                ranks[r, p] = new
    return done[done >= 0], count


def _merge_blocks(vocabulary: Vocabulary, piece: np.ndarray, width: int) -> np.ndarray:
    """Ids of one long piece, whose row of the matrix is folded into blocks.

    A round merges the leftmost pair of the smallest rank, as in any row, but
    compacts its block alone and looks for the smallest rank among the blocks'
    own, so it costs about the number of blocks plus their width. The rank of a block's
    last token is that of its pair with the next block's first one.
    """
    n, blocks = len(piece), -(-len(piece) // width)
    flat = np.full(blocks * width, -1, np.int64)
    flat[:n] = vocabulary.byte_id[piece]
    ranks = np.full(blocks * width, NONE)
    ranks[: n - 1] = vocabulary.pair_ranks(flat[: n - 1], flat[1:n])
    ids, ranks = flat.reshape(blocks, width), ranks.reshape(blocks, width)
    count = np.minimum(width, n - width * np.arange(blocks)).tolist()
    least = ranks.min(1)
    after, before = list(range(1, blocks + 1)), list(range(-1, blocks - 1))  # blocks that still hold tokens
    look = vocabulary.pair_rank
    while True:
        j = int(least.argmin())
        if least[j] == NONE:
            break
        i = int(ranks[j].argmin())
        ids[j, i] = ranks[j, i]
        other, at = (j, i + 1) if i + 1 < count[j] else (after[j], 0)  # the right token of the pair leaves its block
        ids[other, at:-1] = ids[other, at + 1 :]
        ranks[other, at:-1] = ranks[other, at + 1 :]
        count[other] -= 1
        ids[other, count[other]], ranks[other, count[other]] = -1, NONE
        if not count[other]:
            after[before[other]] = after[other]
            if after[other] < blocks:
                before[after[other]] = before[other]
        right = ids[j, i + 1] if i + 1 < count[j] else ids[after[j], 0] if after[j] < blocks else -1
        ranks[j, i] = look(int(ids[j, i]), int(right)) if right >= 0 else NONE
        if i:
            ranks[j, i - 1] = look(int(ids[j, i - 1]), int(ids[j, i]))
        elif before[j] >= 0:
            k = before[j]
            ranks[k, count[k] - 1] = look(int(ids[k, count[k] - 1]), int(ids[j, 0]))
            least[k] = ranks[k].min()
        least[j] = ranks[j].min()
        if other != j and other < blocks:
            least[other] = ranks[other].min()
    return ids[ids >= 0]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all pieces in order, and offsets."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(pieces) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    counts = np.zeros(len(pieces), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    edges = [0, 2, 4, 6, 8, 10, 12, 16, 24, 40, 80, 160, LONG]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        for block in range(0, len(rows), 65536):
            own = rows[block : block + 65536]
            flat, counts[own] = _merge_matrix(vocabulary, raw, starts[own], lengths[own])
            parts.append((own, flat))
    for i in np.flatnonzero(lengths > LONG):
        flat = _merge_blocks(vocabulary, raw[starts[i] : starts[i] + lengths[i]], BLOCK)
        counts[i] = len(flat)
        parts.append((np.array([i]), flat))
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    out = np.zeros(int(at[-1]), np.int32)
    for own, flat in parts:
        out[ragged(at[own], counts[own])] = flat
    return out, at


class Encoder:
    """Encodes texts; distinct units (a word with the space before it) are encoded once and remembered.

    Once ``REMEMBER`` bytes are full the units known stay, others are encoded
    for each block anew; if these make up half of a block, all is forgotten.

    A space before a character that isn't white space always begins a match of
    the split pattern, so a text may be cut there first and each unit be split
    by the pattern alone.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self.split = vocabulary, pattern, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.size, self.full = np.zeros(0, np.int32), np.zeros(1, np.int64), 0, False

    def _units(self, text: str) -> list[str]:
        parts = text.split(" ")
        if "" in parts or _SPACE_SPACE.search(text):
            units: list[str] = []
            for i, part in enumerate(parts):
                if i and (not part or part[0].isspace()):
                    units[-1] += " " + part
                elif part or not i:
                    units.append(" " + part if i else part)
            return [u for u in units if u]
        return [parts[0], *[" " + p for p in parts[1:]]]

    def _encode_units(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct units, and the end of each."""
        split, groups = self.split.findall, []
        pieces: list[bytes] = []
        index: dict[str, int] = {}
        of: list[int] = []
        for unit in new:
            found = split(unit) if len(unit) < 1 << 16 else (m[0] for m in self.split.finditer(unit))
            size = len(of)
            for piece in found:
                k = index.get(piece)
                if k is None:
                    k = index[piece] = len(pieces)
                    pieces.append(piece.encode())
                of.append(k)
            groups.append(len(of) - size)
        flat, at = encode_pieces(self.vocabulary, pieces)
        pick = np.array(of, np.int64)
        counts = np.diff(at)[pick] if len(pick) else np.zeros(0, np.int64)
        ids = flat[ragged(at[pick], counts)] if len(pick) else flat[:0]
        return ids, np.concatenate(([0], np.cumsum(counts)))[np.cumsum(groups)]

    def _ids(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of units, and the count for each; all new units are encoded in one go."""
        if self.full and 2 * sum(u not in self.known for u in block) > len(block):
            self.forget()
        names, flat, at = self.known, self.flat, self.at
        new = [u for u in dict.fromkeys(block) if u not in names]
        if new:
            ids, ends = self._encode_units(new)
            number = dict(zip(new, range(len(names), len(names) + len(new)), strict=True))
            flat, at = np.concatenate((flat, ids)), np.concatenate((at, len(flat) + ends)).astype(np.int64)
            if self.full:
                names = names | number
            else:
                names.update(number)
                self.flat, self.at = flat, at
                self.size += sum(map(len, new)) + UNIT * len(new) + ids.nbytes
                self.full = self.size > REMEMBER
        pick = np.fromiter(map(names.__getitem__, block), np.int64, len(block))
        size = at[pick + 1] - at[pick]
        return flat[ragged(at[pick], size)], size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts."""
        flats, counts = [], np.zeros(len(texts) + 1, np.int64)
        block: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            flat, size = self._ids(block)
            flats.append(flat)
            ends = np.concatenate(([0], np.cumsum(size)))
            at = 0
            for i, n in owner:
                counts[i + 1] += ends[at + n] - ends[at]
                at += n
            block.clear()
            owner.clear()

        for i, text in enumerate(texts):
            units = self._units(text) if text else []
            for at in range(0, len(units), 1 << 16):
                part = units[at : at + (1 << 16)]
                block += part
                owner.append((i, len(part)))
                if len(block) >= 1 << 16:
                    flush()
        if block:
            flush()
        return np.concatenate(flats) if flats else np.zeros(0, np.int32), np.cumsum(counts)


def _gather(flat: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    ids = ids.astype(np.int64)
    return flat[ragged(at[ids], at[ids + 1] - at[ids])].tobytes()


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    return _gather(vocabulary.token_bytes, vocabulary.token_at, ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and the token ids of the whole text as array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))

    def make():
        encoder = Encoder(shared.value, pattern)

        def run(column: pa.Array) -> list[pa.Array]:
            flat, at = encoder.encode([x or "" for x in column.to_pylist()])
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))]

        return run

    return map_texts(docs, text, keep, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """``keep`` and the bytes of the ids; null ids give no bytes. Ids outside the vocabulary raise an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    names = [c for c in dict.fromkeys(keep) if c.lower() != out.lower()]
    source = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            own = [decode_ids(shared.value, np.array(x or [], np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(own, pa.binary())], names=[*names, out])

    return map_arrow(source, run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, and SHA-256 digests of the ids (decimal, joined by commas) and of the bytes they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        vocabulary = shared.value
        encoder = Encoder(shared.value, pattern)

        def run(column: pa.Array) -> list[pa.Array]:
            flat, at = encoder.encode([x or "" for x in column.to_pylist()])
            names, values = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                names.append(hashlib.sha256(_gather(vocabulary.word_bytes, vocabulary.word_at, flat[a:b])[:-1]).hexdigest())
                values.append(hashlib.sha256(decode_ids(vocabulary, flat[a:b])).hexdigest())
            return [pa.array(np.diff(at), pa.int64()), pa.array(names, pa.string()), pa.array(values, pa.string())]

        return run

    return map_texts(docs, text, keep, fields, make)
