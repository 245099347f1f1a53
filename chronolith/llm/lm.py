"""LM scoring: a unigram base over all training tokens and a gated recurrent model.

Tokens are lower-cased words, then one end. All training tokens are counted by
Spark. Words of at least a threshold count, ``FREQUENT`` of them at most, are
broadcast with their counts (a bound by construction: the threshold is taken from the histogram
of counts); the counts of all rarer words stay distributed and meet the rare words of the
documents in a join on the word, so the vocabulary may be of any size.

The recurrent model (module ``gru``) has the most frequent ``OUTPUTS`` words and the
end as inputs and outputs, in classes that grow with them, and one group for all others; within that group a
word has (c + 1) / (N' + V' + 1) of tokens N' and different words V' there, so
unseen words have a probability too and texts are scored whole.

Texts are made numbers once, and training texts dealt to shards of about ``BLOCK`` tokens by a
hash of id and text. In each of ``ROUNDS`` rounds a part of the shards is learnt from, each by itself
and in the order of the hash, starting from the weights of the round before, and the changes are averaged: those of a
word or a class by the tokens that touched it in each shard, so that a word of few shards isn't diluted
by the others, and all else by tokens. Every training text is learnt from once. Shards, and the order in which
their changes are summed, don't depend on how the table is split into files or tasks. Changes travel
as half floats, for touched rows only, and are merged in two steps.

Rows: null and empty texts have one token, the end; ids may be null (then
learnt from, and not held out) or repeated. Without training texts all counts are
0, and both scores are still defined. Scores have six digits, as products may round by what they are computed beside.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, map_arrow, steps, text_bytes, written
from .gru import CLASS, ROWS, Gru, one_thread
from .subwords import sums

FREQUENT = 1 << 18
#: Words of the recurrent model, whose numbers, and that of all others, have 16 bits.
OUTPUTS = (1 << 16) - 16
ROUNDS = 2
#: Tokens of a shard, about; a task holds twice as many at most, and a text.
BLOCK = 1 << 20
#: Parts in which the changes of all shards are summed before their sums are.
PARTS = 16
#: Rows of a parameter whose changes travel together.
ROWS_AT_ONCE = 512
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Logarithmic bins of counts, for each doubling.
_FINE = 16


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts in a row, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if some.all():
        return flat, sizes
    return flat.filter(pa.array(some)), sums(some.astype(np.int64), sizes).astype(np.int64)


def _source(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all words of whole texts; ends aren't words. Counted in the task first, then combined."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def run(batches):
        held, n = [], 0
        for part in steps(batches, limit=4 << 20):
            flat, _ = words(part.column(0))
            found = pc.value_counts(flat)
            held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            n += len(found)
            if n > 2 * COUNTED:
                held = [merged(held)]
                n = held[0].num_rows
                if n > COUNTED:
                    yield from held.pop().to_batches()
                    n = 0
        if held:
            yield from merged(held).to_batches()

    return _source(docs, text).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _bin(c: Column) -> Column:
    return F.floor(F.log2(c.cast("double")) * _FINE).cast("int")


class Lexicon:
    """Frequent words by falling count, their counts, and the totals of training tokens."""

    def __init__(self, rows: list[tuple[str, int]], texts: int, tokens: int, types: int, outputs: int = OUTPUTS):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.texts, self.n, self.v = texts, tokens + texts, types + (texts > 0)
        self.words = pa.array([w for w, _ in rows], pa.string())
        self.counts = np.array([texts] + [c for _, c in rows], np.int64)  # 0 is the end
        self.outputs = min(outputs, len(self.counts))
        own = self.counts[: self.outputs]
        self.rare_n, self.rare_v = self.n - int(own.sum()), self.v - int((own > 0).sum())

    def shape(self) -> tuple[np.ndarray, float]:
        """What a model starts from: counts of its words, padded, and of all others together."""
        counts = np.zeros(-(-self.outputs // CLASS) * CLASS)
        counts[: self.outputs] = self.counts[: self.outputs]
        return counts, float(self.rare_n)

    def model(self) -> Gru:
        return Gru(*self.shape())

    def numbers(self, own: pa.Array) -> np.ndarray:
        """Numbers of words; -1 for those that aren't frequent."""
        return pc.add(pc.index_in(own, value_set=self.words), 1).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def rare(self) -> int:
        """The model's number of words beyond its own: the one after the padded outputs."""
        return -(-self.outputs // CLASS) * CLASS

    @property
    def kind(self) -> type:
        """Of the model's numbers as they are written."""
        return np.uint16 if self.rare < 1 << 16 else np.int32

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Numbers for the model."""
        return np.where((ids < 0) | (ids >= self.outputs), self.rare, ids).astype(self.kind)


def learn_lexicon(counts: DataFrame, texts: int, frequent: int = FREQUENT, outputs: int = OUTPUTS) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the counts of the words that are not in it."""
    binned = counts.withColumn("bin", _bin(F.col("c")))
    bins = sorted(((r["bin"], r["n"], r["c"]) for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
    cut, most = (bins[0][0] + 1 if bins else 0), 0
    for b, n, _ in bins:
        if most + n > frequent:
            break
        cut, most = b, most + n
    rows = [(r["word"], r["c"]) for r in binned.where(F.col("bin") >= cut).select("word", "c").collect()]  # at most ``frequent``
    return Lexicon(rows, texts, sum(c for _, _, c in bins), sum(n for _, n, _ in bins), outputs), binned.where(F.col("bin") < cut).select("word", "c")


_FIELDS = [("n_tokens", pa.int64(), T.LongType()), ("known", pa.int64(), T.LongType()), ("logs", pa.float64(), T.DoubleType()), ("rare", pa.int64(), T.LongType()), ("inner", pa.float64(), T.DoubleType()), ("ids", pa.binary(), T.BinaryType()), ("others", pa.list_(pa.string()), T.ArrayType(T.StringType())), ("times", pa.list_(pa.int64()), T.ArrayType(T.LongType()))]


def numbered(docs: DataFrame, lexicon: Lexicon, training: Column, text: str = "text", doc_id: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each text: ``keep``, learnt, place (a hash of id and text) and all of the text that the rest needs.

    known, logs: tokens with a count among the lexicon's, and the sum of log10(c + 1) over them; rare: words beyond the
    model's; inner: that sum over those of them in the lexicon; ids: the model's
    numbers; others, times: the words beyond the lexicon.
    """
    keep = keep or {}
    place = F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    source = _source(docs, text, *[c.alias(n) for n, c in keep.items()], F.coalesce(training, F.lit(False)).alias("learnt"), place.alias("place"))
    names = [*keep, "learnt", "place"]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(n, k) for n, _, k in _FIELDS])

    def run(batches):
        lexicon = shared.value
        logs = np.log10(lexicon.counts + 1.0)
        for part in steps(batches, limit=4 << 20):
            each, counts = words(part.column(len(names)))
            ids = lexicon.numbers(each)
            met, modelled = ids >= 0, (ids >= 0) & (ids < lexicon.outputs)
            log = np.where(met, logs[ids], 0.0)
            edges = np.concatenate(([0], np.cumsum(counts)))
            unknown = np.flatnonzero(~met)
            rare = pa.table({"text": np.searchsorted(edges, unknown, "right") - 1, "word": each.take(pa.array(unknown))}).group_by(["text", "word"]).aggregate([([], "count_all")]).sort_by("text").combine_chunks()
            ends = np.searchsorted(rare["text"].to_numpy(), np.arange(len(counts) + 1)).astype(np.int32)
            others, times = (pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([pa.array([], t), *rare[c].chunks])) for c, t in (("word", pa.string()), ("count_all", pa.int64())))
            inputs = lexicon.inputs(ids)
            inputs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges * inputs.itemsize), pa.py_buffer(inputs)])
            columns = [counts + 1, sums(met.astype(np.int64), counts).astype(np.int64) + (lexicon.texts > 0), sums(log, counts) + logs[0], counts - sums(modelled.astype(np.int64), counts).astype(np.int64), sums(np.where(modelled, 0.0, log), counts), inputs.cast(pa.binary()), others, times]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t, _) in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + arrays, names=[*names, *[n for n, _, _ in _FIELDS]])

    return map_arrow(source, run, schema)


def train(told: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, block: int = BLOCK) -> np.ndarray:
    """Weights of the recurrent model after ``rounds`` of training by shards and averaging. ``told``: of ``numbered``."""
    context = told.sparkSession.sparkContext
    shape, kind = lexicon.shape(), lexicon.kind
    shards = max(1, round(lexicon.n / block))
    rounds = min(rounds, shards)
    rows = told.where("learnt").select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "ids")
    weights = lexicon.model().flat()
    for k in range(rounds):
        now = context.broadcast(weights)

        def fit(batches, now=now):
            one_thread()
            start = Gru(*shape, seed=None).load(now.value)
            for shard, streams in _by_shard(batches, block, kind):
                model = Gru(*shape, seed=None).load(now.value)
                for stream in streams:
                    model.fit(stream)
                for name, own, met, change in model.changes(start):
                    of = own // ROWS_AT_ONCE
                    for edge in np.split(np.arange(len(own)), np.flatnonzero(np.diff(of)) + 1):
                        yield _changes(shard, name, int(of[edge[0]]), own[edge], met[edge].astype(np.float64), change[edge].astype(np.float16))

        mine = -(-(shards - k) // rounds)
        dealt = rows.where(F.col("shard") % rounds == k).withColumn("part", F.expr(f"cast(shard div {rounds} as int)"))
        local = dealt.repartitionById(mine, "part").sortWithinPartitions("shard", "place", "ids").select("shard", "ids").mapInArrow(fit, _CHANGES)
        if mine > PARTS:
            local = local.repartition("name", "block", F.col("shard") % PARTS).sortWithinPartitions("name", "block", F.col("shard") % PARTS, "shard").mapInArrow(_merge(np.float16, PARTS), _CHANGES)
        merged = local.repartition("name", "block").sortWithinPartitions("name", "block", "shard").mapInArrow(_merge(np.float16 if mine <= PARTS else np.float32, 0), _CHANGES).collect()  # at most one change of each weight
        model = lexicon.model().load(weights)
        for r in merged:
            own, p = np.frombuffer(r["rows"], np.int64), model.p[r["name"]]
            p = p if r["name"] in ROWS else p[None]
            p[own] += np.frombuffer(r["change"], np.float32).reshape(p[own].shape)
        weights = model.flat()
        now.unpersist()
    return weights


def _by_shard(batches, block: int, kind: type):
    """(shard, its streams of tokens, an end after each text) from rows (shard, ids) that are sorted by shard."""

    def texts():
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            tokens = np.frombuffer(raw.tobytes(), kind).astype(np.int32)
            at = at // np.dtype(kind).itemsize
            for shard, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield shard, tokens[a:b]

    def streams(own):
        held, n = [], 0
        for _, ids in own:
            held.append(np.append(ids, np.int32(0)))
            n += len(ids) + 1
            if n >= 2 * block:
                whole = np.concatenate(held)
                cut = len(whole) // block * block
                for at in range(0, cut, block):
                    yield whole[at : at + block]
                held, n = [whole[cut:].copy()], len(whole) - cut
        if n:
            yield np.concatenate(held)

    for shard, own in groupby(texts(), key=lambda row: row[0]):
        yield shard, streams(own)


def _merge(kind: type, parts: int):
    """Averages of changes that follow each other, by the tokens behind them; of each part of the shards, or of all."""

    def run(batches):
        now, met, change = None, None, None

        def done():
            rows = np.flatnonzero(met)
            return _changes(now[2], now[0], now[1], rows + now[1] * ROWS_AT_ONCE, met[rows], (change[rows] / met[rows, None]).astype(np.float32))

        for batch in batches:
            for r in batch.to_pylist():
                rows, n = np.frombuffer(r["rows"], np.int64) % ROWS_AT_ONCE, np.frombuffer(r["met"], np.float64)
                own = np.frombuffer(r["change"], kind).reshape(len(rows), -1) * n[:, None]
                key = r["name"], r["block"], r["shard"] % parts if parts else 0
                if key != now:
                    if now:
                        yield done()
                    size = ROWS_AT_ONCE if r["name"] in ROWS else 1
                    now, met, change = key, np.zeros(size), np.zeros((size, own.shape[1]))
                met[rows] += n
                change[rows] += own
        if now:
            yield done()

    return run


_CHANGES = "shard int, name string, block long, rows binary, met binary, change binary"


def _changes(shard: int, name: str, block: int, *arrays: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([x.tobytes()], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([block], pa.int64()), *packed], names=["shard", "name", "block", "rows", "met", "change"])


def _stated(told: DataFrame, names: list[str], lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """``names``, and state: the model's log10 likelihood of each text, with words beyond its own as one token."""
    shape, kind, now = lexicon.shape(), lexicon.kind, told.sparkSession.sparkContext.broadcast(weights)
    source = told.select(*names, "ids")
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("state", T.DoubleType())])

    def run(batches):
        one_thread()
        model = Gru(*shape, seed=None).load(now.value)
        for part in steps(batches, "ids"):
            raw, at = text_bytes(part.column(len(names)))
            state = model.score(np.frombuffer(raw.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize) / np.log(10)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [pa.array(state)], names=[*names, "state"])

    return map_arrow(source, run, schema)


def score(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS, block: int = BLOCK, frequent: int = FREQUENT, outputs: int = OUTPUTS) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score for each row. ``training``: which rows to learn from."""
    learnt = docs.where(training)
    counts = written(count_words(learnt, text))
    lexicon, rarer = learn_lexicon(counts, learnt.count(), frequent, outputs)
    names = carried(docs, keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    inner = [f"__k{i}" for i in range(len(names))]
    kept = {n: F.col(f"`{c}`") for c, n in zip(names, inner, strict=True)}
    # Written with a number for each row, so that the rare words' sums find their row again.
    told = written(numbered(docs, lexicon, training, text, doc_id, kept).withColumn("__row", F.monotonically_increasing_id()))
    weights = train(told, lexicon, rounds, block)
    other = told.where(F.size("others") > 0).select("__row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("__row", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    found = other.join(rarer, "word").groupBy("__row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("met"))
    rows = _stated(told, [*inner, "__row", "n_tokens", "known", "logs", "rare", "inner"], lexicon, weights)
    full = rows.join(found, "__row", "left").na.fill({"more": 0.0, "met": 0})
    base = F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(lexicon.n + lexicon.v + 1)))
    by_model = F.col("state") + F.col("inner") + F.col("more") - F.col("rare") * F.lit(float(np.log10(lexicon.rare_n + lexicon.rare_v + 1)))
    return full.select(
        *[F.col(n).alias(c) for c, n in zip(names, inner, strict=True)],
        "n_tokens",
        (F.col("known") + F.col("met")).alias("n_known"),
        F.lit(lexicon.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.round(by_model, 6).alias("score"),
    )
