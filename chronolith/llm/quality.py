"""Quality classifier by supervised subword embeddings.

A word has a vector, and so has each hashed byte 3- to 5-gram of ``<word>``; one
more vector stands for a word that repeats the word before. The mean of all of
a document's vectors goes through a softmax. Vectors and output are learnt
together by stochastic gradient descent in numpy on the driver, from at most
``SAMPLE`` labelled documents picked by a hash of their id (a documented bound
for fitting; their hashed feature counts are made on the executors). As the
output is linear in the mean, scoring needs one number a bucket, which is all
that is broadcast; every word of every text counts.

Rows: null and empty texts get the score of the bias alone; repeated rows score
alike. Labels that are null, not 0 or 1, or contradict each other for one id are left out;
without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, steps, text_bytes
from .subwords import WordTable, grams, sampled, sums, whole_words

SAMPLE = 4000
BUCKETS = 1 << 15
SIZES = (3, 4, 5)
DIMENSION = 8
EPOCHS = 12
RATE = 4.0
#: The bucket of a word that repeats the one before.
SAME = BUCKETS
THRESHOLD = 0.3


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all features of some words."""
    owner, bucket = grams(words, SIZES, BUCKETS)
    return np.concatenate((np.arange(len(words)), owner)), np.concatenate((whole_words(words, BUCKETS, 1), bucket))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = text.split()
    once = {w: i for i, w in enumerate(dict.fromkeys(words))}
    of = np.fromiter(map(once.__getitem__, words), np.int64, len(words))
    times = np.bincount(of, minlength=len(once)).astype(np.float64)
    owner, bucket = features(list(once)) if once else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.bincount(bucket, weights=times[owner], minlength=BUCKETS + 1)
    total[SAME] += int((of[1:] == of[:-1]).sum())
    where = np.flatnonzero(total)
    return where, total[where]


def gradients(own: np.ndarray, output: np.ndarray, bias: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's negative log-likelihood, by its buckets' vectors, the output and the bias."""
    hidden = share @ own
    z = output @ hidden + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return np.outer(share, p @ output), np.outer(p, hidden), p


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> tuple[np.ndarray, float]:
    """The log odds that each bucket contributes, and the bias. ``rows``: buckets, counts, label."""
    if len({label for _, _, label in rows}) < 2:
        return np.zeros(BUCKETS + 1), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS + 1, DIMENSION))
    output, bias = np.zeros((2, DIMENSION)), np.zeros(2)
    step, steps_ = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, count, label = rows[i]
            rate = RATE * (1 - step / steps_)
            step += 1
            share = count / max(1.0, count.sum())
            of_vectors, of_output, of_bias = gradients(vectors[bucket], output, bias, share, label)
            output -= 0.1 * rate * of_output
            bias -= 0.02 * rate * of_bias
            vectors[bucket] -= rate * of_vectors
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on at most ``sample`` of the rows given; leave out beforehand what it may not see."""
    valid = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label"))
    n = valid.agg(F.approx_count_distinct("__id")).first()[0]
    # Twice as many as wanted pass the hash, and the first of them in its order stay, however rows are dealt.
    some = valid.where(sampled(F.col("__id"), 2 * sample / max(1, n))).groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
    picked = some.where("__label = __most").orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit(1)), "__id").select("__id", "__label").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text")).join(F.broadcast(picked), "__id")
    # Ids may be repeated in the table: of each the text of the least hash counts.
    rows = rows.groupBy("__id").agg(F.min_by(F.struct("__label", "__text"), F.xxhash64("__text")).alias("r")).select("r.*")

    def run(batches):
        for part in steps(batches):
            raw, at = text_bytes(part.column(1))
            view = raw.tobytes()
            found = [counted(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.astype(np.uint16).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())], names=["label", "bucket", "times"])

    got = rows.mapInArrow(run, "label int, bucket binary, times binary").collect()
    data = sorted((bytes(r.bucket), bytes(r.times), r.label) for r in got)  # one order, however the rows came
    return fit([(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(c, np.float32).astype(np.float64), y) for b, c, y in data])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        odds, bias = shared.value

        def compute(words: list[bytes]) -> np.ndarray:
            owner, bucket = features(words)
            return np.column_stack((np.bincount(owner, weights=odds[bucket], minlength=len(words)), np.bincount(owner, minlength=len(words))))

        table = WordTable(compute, 2)

        def run(column: pa.Array) -> list[pa.Array]:
            raw, at = text_bytes(column)
            view = raw.tobytes()
            parts = [view[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = table.ids([w for words in parts for w in words])
            total = sums(table.table[ids], counts)
            owner = np.repeat(np.arange(len(parts)), counts)
            same = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(parts)) if len(ids) else np.zeros(len(parts))
            z = (total[:, 0] + same * odds[SAME]) / np.maximum(1, total[:, 1] + same) + bias
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())]

        return run

    return map_texts(docs, text, keep, [T.StructField(out, T.DoubleType())], make, limit=4 << 20)
