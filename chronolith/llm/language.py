"""Language ID by a linear-chain conditional random field over words.

Each word of a text has a label. Its score for a language sums learnt weights
of hashed byte 1- to 4-grams of ``<word>`` (those with ``<`` or ``>`` are its affixes),
of the word itself, and of lexicons: for each language the words that the
sample holds most often there. Learnt transition weights tie neighbours together, so
code-switched text gets runs of labels. Marginals come from forward-backward
over the whole text; a text's language is the one of the largest mean marginal.

Training data are whole texts of about ``SAMPLE`` documents, picked by a hash of
id and text, as many for each language (a documented bound of rows for fitting the
classifier). They are cut into pieces, and pieces of two documents are
joined, so that the transitions see switches. Gradients are those of
the conditional likelihood: marginals and expected transitions by
forward-backward, in numpy on the driver. Over ``MOST_LANGUAGES`` languages raise an error.

Rows: null texts and such without a letter are ``und`` with score 0; repeated
rows are labelled alike. Null languages are not learnt. With nothing to learn
from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, steps, text_bytes
from .subwords import WordTable, grams, whole_words

SAMPLE = 3000
MOST_LANGUAGES = 256
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
LEXICON = 300
SEQUENCE = 64
EPOCHS = 2
RATE = 0.3
PENALTY = 1e-4
UNKNOWN = "und"
#: ``assign`` rejects a text whose best language is hardly better than chance: by less than this part of the way to 1.
ABOVE_CHANCE = 0.05
#: Numbers of a matrix that a step works on (words by languages).
CELLS = 1 << 21
_LETTER = regex.compile(r"\p{L}")
# ASCII letters, lower-cased, and all bytes from 128 on make words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pass(at_step: Callable[[int, int], np.ndarray], active: np.ndarray, move: np.ndarray, visit: Callable, cells: int) -> None:
    """Forward-backward over texts side by side, the longest first; ``visit(t, a, b, e)`` gets every step, the last first.

    ``at_step(t, m)`` gives e, the exp of the scores of the t-th words of the first
    m texts, and ``active[t]`` texts have more than t words. ``move`` is the exp of the
    transition weights. a and b are the forward and backward values, each row scaled by a number of its own.
    Forward values are kept for about ``cells`` numbers of steps at a time; those of longer texts are computed anew
    for each such stretch from the state before it.
    """
    before = np.concatenate(([0], np.cumsum(active))) * len(move)
    cuts = [0]
    while cuts[-1] < len(active):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(before, before[cuts[-1]] + cells, "right")) - 1))

    def ahead(a: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray]:
        e = at_step(t, int(active[t]))
        a = e if a is None else (a[: len(e)] @ move) * e
        return a / a.sum(1, keepdims=True), e

    heads: list[np.ndarray | None] = [None]
    for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
        a = heads[-1]
        for t in range(low, high):
            a, _ = ahead(a, t)
        heads.append(a)
    b, after = np.ones((0, len(move))), None
    for head, low, high in reversed(list(zip(heads, cuts[:-1], cuts[1:], strict=False))):
        kept = []
        for t in range(low, high):
            kept.append(ahead(head if t == low else kept[-1][0], t))
        for t in range(high - 1, low - 1, -1):
            a, e = kept.pop()
            if len(b):
                b = (after * b) @ move.T
                b /= b.sum(1, keepdims=True)
            if len(b) < len(a):
                b = np.concatenate((b, np.ones((len(a) - len(b), len(move)))))
            visit(t, a, b, e)
            after = e


def _active(lengths: np.ndarray) -> np.ndarray:
    """Texts with more than t words for each t; ``lengths`` fall."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")


def _marginal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a * b
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300)


def expectations(e: np.ndarray, begins: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and the expected number of each transition, under the model."""
    marginal, moves, ahead = np.zeros_like(e), np.zeros_like(move), None

    def visit(t: int, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> None:
        nonlocal ahead
        marginal[begins[: len(a)] + t] = _marginal(a, b)
        if ahead is not None:
            pair = a[: len(ahead), :, None] * move * ahead[:, None, :]
            moves[:] += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        ahead = own * b

    _pass(lambda t, m: e[begins[:m] + t], _active(lengths), move, visit, CELLS)
    return marginal, moves


class Model:
    def __init__(self, languages: list[str], lexicons: list[set[bytes]]):
        self.languages, self.lexicons = languages, lexicons
        n = len(languages)
        self.weights = np.zeros((2 * BUCKETS + n, n))
        self.move = np.zeros((n, n))

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = grams(words, SIZES, BUCKETS)
        parts = [(owner, bucket), (np.arange(len(words)), whole_words(words, BUCKETS, 2) + BUCKETS)]
        for k, lexicon in enumerate(self.lexicons):
            own = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
            parts.append((own, np.full(len(own), 2 * BUCKETS + k)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def scores(self, words: list[bytes]) -> np.ndarray:
        """exp of the word scores; the largest of a word is 1."""
        owner, feature = self.features(words)
        z = np.column_stack([np.bincount(owner, weights=self.weights[feature, k], minlength=len(words)) for k in range(len(self.languages))])
        return np.exp(np.maximum(z - z.max(1, keepdims=True), -60.0))

    def fit(self, sequences: list[tuple[list[bytes], list[int]]], seed: int = 0) -> None:
        """Adaptive gradient steps on blocks of 64 sequences."""
        rng = np.random.default_rng(seed)
        n = len(self.languages)
        square, square_move = np.full_like(self.weights, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(sequences))
            for at in range(0, len(order), 64):
                block = sorted((sequences[i] for i in order[at : at + 64]), key=lambda s: -len(s[0]))
                words = [w for s in block for w in s[0]]
                truth = np.array([y for s in block for y in s[1]])
                lengths = np.array([len(s[0]) for s in block])
                begins = np.cumsum(lengths) - lengths
                once = {w: i for i, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(once.__getitem__, words), np.int64, len(words))
                owner, feature = self.features(list(once))
                z = np.column_stack([np.bincount(owner, weights=self.weights[feature, k], minlength=len(once)) for k in range(n)])
                e = np.exp(np.maximum(z - z.max(1, keepdims=True), -60.0))[ids]
                move = np.exp(self.move)
                marginal, expected = expectations(e, begins, lengths, move)
                error = marginal.copy()
                error[np.arange(len(truth)), truth] -= 1
                by_word = np.column_stack([np.bincount(ids, weights=error[:, k], minlength=len(once)) for k in range(n)])
                used, back = np.unique(feature, return_inverse=True)
                g = np.column_stack([np.bincount(back, weights=by_word[owner, k], minlength=len(used)) for k in range(n)]) / len(block)
                g += PENALTY * self.weights[used]
                square[used] += g * g
                self.weights[used] -= RATE * g / np.sqrt(square[used])
                inner = np.ones(len(truth), bool)
                inner[begins] = False
                right = np.flatnonzero(inner)
                np.subtract.at(expected, (truth[right - 1], truth[right]), 1)
                g = expected / len(block) + PENALTY * self.move
                square_move += g * g
                self.move -= 0.1 * g / np.sqrt(square_move)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on whole texts of the rows given; leave out beforehand what it may not see."""
    place = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string")), F.lit(1 << 30))
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), place.alias("place")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: transitions and weights of so many don't fit one model")
    if not counts:
        return Model([], [])
    languages = sorted(counts)
    each = max(1, sample // len(languages))
    # Four times as many rows as wanted pass the hash, and the first of each language in its order stay, so the sample doesn't depend on how rows are dealt.
    bound = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1 << 30, 4 * each * (1 << 30) // counts[name] + 1))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    picked = rows.where(F.col("place") < bound[F.col("lang")]).withColumn("rank", rank).where(F.col("rank") <= each)

    def run(batches):
        for part in steps(batches):
            raw, at = text_bytes(part.column(1))
            view = raw.tobytes().translate(_FOLD)
            folded = [b" ".join(view[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(folded, pa.binary())], names=["lang", "words"])

    got = picked.select("lang", F.col("text").alias("__text")).mapInArrow(run, "lang string, words binary").collect()  # ``sample`` texts at most
    number = {name: i for i, name in enumerate(languages)}
    return fit_texts(languages, [(w.split(), y) for w, y in sorted((bytes(r.words), number[r.lang]) for r in got if r.words)])


def fit_texts(languages: list[str], texts: list[tuple[list[bytes], int]], seed: int = 0) -> Model:
    tally: list[dict[bytes, int]] = [{} for _ in languages]
    for words, y in texts:
        for w in words:
            tally[y][w] = tally[y].get(w, 0) + 1
    lexicons = [set(sorted(t, key=lambda w: (-t[w], w))[:LEXICON]) for t in tally]
    model = Model(languages, lexicons)
    rng = np.random.default_rng(seed)
    pieces = [(words[a : a + SEQUENCE // 2], y) for words, y in texts for a in range(0, len(words), SEQUENCE // 2)]
    order = rng.permutation(len(pieces))
    sequences = []
    for i in range(0, len(order), 2):
        pair = [pieces[j] for j in order[i : i + 2]]
        if i % 4 and len(pair) == 2:  # half of them keep to one text
            sequences += [(w, [y] * len(w)) for w, y in pair]
        else:
            sequences.append(([w for words, _ in pair for w in words], [y for words, y in pair for _ in words]))
    model.fit(sequences, seed)
    return model


class Labeller:
    """Marginals for whole texts, many at a time."""

    def __init__(self, model: Model):
        self.n = len(model.languages)
        self.table = WordTable(model.scores, self.n, max(1, min(200_000, 2 * CELLS // self.n)))
        self.move = np.exp(model.move)

    def _visit(self, texts: list[bytes], visit: Callable[[int, np.ndarray, np.ndarray], None]) -> np.ndarray:
        """Calls ``visit(t, texts, marginals of their t-th words)``; the number of words of each text. ``texts`` are folded."""
        self.table.begin()
        parts, counts, words = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            for own in _in_blocks(text):
                counts[i] += len(own)
                words += own
                if len(words) > 1 << 16:
                    parts.append(self.table.ids(words, forget=False).astype(np.int32))
                    words = []
        if words:
            parts.append(self.table.ids(words, forget=False).astype(np.int32))
        ids, scores = np.concatenate(parts), self.table.table
        order = np.argsort(-counts, kind="stable")
        begins = (np.cumsum(counts) - counts)[order]
        _pass(lambda t, m: scores[ids[begins[:m] + t]], _active(counts[order]), self.move, lambda t, a, b, _: visit(t, order[: len(a)], _marginal(a, b)), CELLS)
        return counts

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        out = [np.zeros((len(t.split()), self.n)) for t in texts]

        def visit(t: int, own: np.ndarray, marginal: np.ndarray) -> None:
            for i, row in zip(own.tolist(), marginal, strict=True):
                out[i][t] = row

        self._visit(texts, visit)
        return out

    def means(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), self.n))

        def visit(_: int, own: np.ndarray, marginal: np.ndarray) -> None:
            total[own] += marginal

        counts = self._visit(texts, visit)
        # Matrix products may round differently from one batch to the next.
        return np.round(total / np.maximum(1, counts)[:, None], 9)


def _in_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a folded text, some of them at a time."""
    at = 0
    while len(text) - at > size:
        space = text.find(b" ", at + size)
        if space < 0:
            break
        yield text[at:space].split()
        at = space
    yield (text[at:] if at else text).split()


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, lang_pred and score (the mean marginal of that language), under the names of ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        languages = shared.value.languages
        labeller = Labeller(shared.value) if languages else None

        def run(column: pa.Array) -> list[pa.Array]:
            originals = column.to_pylist()
            fine = [bool(labeller and x and _LETTER.search(x)) for x in originals]
            if not any(fine):
                return [pa.array([UNKNOWN] * len(fine), pa.string()), pa.array([0.0] * len(fine), pa.float64())]
            means = labeller.means([x.encode().translate(_FOLD) if f else b"" for x, f in zip(originals, fine, strict=True)])
            best = means.argmax(1)
            top = np.minimum(1.0, means[np.arange(len(best)), best])
            # A letter is a word of its own or part of one, so a fine text has words.
            return [pa.array([languages[k] if f else UNKNOWN for k, f in zip(best, fine, strict=True)], pa.string()), pa.array(np.where(fine, top, 0.0), pa.float64())]

        return run

    # A step's matrices have about CELLS numbers: words of some six bytes, times languages.
    limit = max(1 << 16, 6 * CELLS // max(1, len(model.languages)))
    return map_texts(docs, text, keep, [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())], make, limit=limit)


def assign(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", above: float = ABOVE_CHANCE) -> DataFrame:
    """The rows with a language, its name in ``lang`` if there is such a column; all else as it was.

    Rows go that are ``und``, or whose best language of n has a mean marginal below 1/n + ``above`` * (1 - 1/n).
    """
    chance = 1 / max(1, len(model.languages))
    least = chance + above * (1 - chance)
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    found = predict(docs.toDF(*inner), model, inner[docs.columns.index(text)], tuple(inner), ("__pred", "__score"))
    fine = found.where((F.col("__pred") != UNKNOWN) & (F.col("__score") >= least))
    return fine.select(*[(F.col("__pred") if c == lang else F.col(i)).cast(docs.schema[c].dataType).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def label_words(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the most likely language of each word, in order; an array of (word, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType())])

    def make():
        languages = shared.value.languages
        labeller = Labeller(shared.value) if languages else None

        def run(column: pa.Array) -> list[pa.Array]:
            texts = [(x or "").encode().translate(_FOLD) for x in column.to_pylist()]
            found = labeller.marginals(texts) if labeller else [np.ones((len(t.split()), 1)) for t in texts]
            names = languages or [UNKNOWN]
            rows = [[{"word": w.decode(), "lang": names[k]} for w, k in zip(t.split(), m.argmax(1).tolist(), strict=True)] for t, m in zip(texts, found, strict=True)]
            return [pa.array(rows, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())])))]

        return run

    return map_texts(docs, text, keep, [T.StructField("words", T.ArrayType(item))], make, limit=1 << 20)
