"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams, so that a misspelling shares vectors
with the word. The vectors in every two neighbouring words of a whole text are averaged and
a softmax of two labels is put on the average; a text is as toxic as its most toxic windows,
of which one in TOP counts, in training as well: the more words, the more of them have to be
toxic. An average over all words would lose a few insults in a long text. In training a
random share of a toxic text's windows is looked at, a new one each time, so that no toxic
word hides behind a plainer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents, by label, that the model is fitted on at most, of different texts, those of lowest hash. Their whole texts are used.
SAMPLE_ROWS = {0: 3000, 1: 1500}
BUCKETS = 1 << 16
DIM = 8
#: Lengths of the n-grams in bytes; the word itself, with its ends, is one more.
GRAMS = (3, 4, 5)
#: An average is over so many n-grams at least, so that a few short words can't sway it.
LEAST = 30
#: A text's score is the mean of its most toxic windows, one and one more for every so many.
TOP = 60
#: Share of a toxic text's windows that a training step looks at.
SHOWN = 0.3
#: Worth of a clean text predicted toxic, as against a toxic text missed, both by share, in placing the cut.
FALSE = 8
#: Factor on the average, which is small as most n-grams are neutral.
SCALE = 20.0
EPOCHS = 8
#: Texts in a training step, and texts whose windows are looked at together.
BATCH = 4
LOT = 32
#: Texts that a task scores together, as they share words.
TOGETHER = 256


@dataclass
class Model:
    """What each bucket adds to the two labels' logits, and their offsets."""

    gain: np.ndarray
    offset: np.ndarray


class Words:
    """Distinct words of some texts, by number; the first is no word, which follows the only word of a text."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}

    def read(self, text: str | None) -> np.ndarray:
        """The words of a whole text in order, repeats included, by number."""
        number = self.number
        found = [number.setdefault(w, len(number)) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]
        return np.array(found if len(found) != 1 else [*found, 0], dtype=np.int32)

    def bags(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of all words, and where each word's begin (one more at the end)."""
        return subwords(list(self.number))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, and where each word's begin (one more at the end); an empty word has none."""
    data = np.frombuffer(b"".join(b"<" + w + b">" if w else b"" for w in words), dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(w) + 2 if w else 0 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes to the word's end
    word = np.repeat(np.arange(len(words)), lengths)
    made, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ data[at + k]
        made.append(_bucket(h))
        owner.append(word[at])
    some = np.flatnonzero(lengths)
    if len(some):
        whole = np.cumsum(data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ** (left.astype(np.uint64) % np.uint64(64)))
        sums = np.diff(np.r_[np.uint64(0), whole[ends[some] - 1]])
        made.append(_bucket((sums >> np.uint64(32)).astype(np.uint32)))
        owner.append(some)
    bucket, owner = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the n-grams' values for each word."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _window_mean(gain: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Mean of the n-grams' values in each two neighbouring words, from sums and numbers of the n-grams by word."""
    a, b = text[:-1], text[1:]
    return (gain[a] + gain[b]) / np.maximum(size[a] + size[b], LEAST)


def _most_toxic(values: np.ndarray) -> np.ndarray:
    """Which windows count: those of highest value."""
    k = 1 + len(values) // TOP
    return np.argpartition(values, len(values) - k)[len(values) - k :]


def _shown(values: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """The windows that count among a random share of all."""
    shown = np.flatnonzero(rng.random(len(values)) < share)
    shown = shown if len(shown) else np.array([int(values.argmax())])
    return shown[_most_toxic(values[shown])]


def pooled(model: Model, texts: list[np.ndarray], bags: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each text the mean difference of the two labels' gains in the windows that count; 0 for a text without words."""
    bucket, starts = bags
    gain, size = _sums((model.gain[:, 1] - model.gain[:, 0])[bucket], starts), np.diff(starts)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if len(text):
            values = _window_mean(gain, size, text)
            out[i] = values[_most_toxic(values)].mean()
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """Fit embeddings and softmax together, by Adagrad over the most toxic windows of a few texts at a time."""
    words = Words()
    rows = [words.read(t) for t in texts]
    y = np.array(labels, dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb, out, offset = rng.normal(0, 0.1, (DIM, BUCKETS)), rng.normal(0, 0.5, (DIM, 2)), np.array([0.5, -0.5])
    seen_emb, seen_out = np.full(BUCKETS, 1e-2), np.full((DIM, 2), 1e-2)
    bucket, starts = words.bags()
    size = np.diff(starts)
    cost = 0.5 / np.clip(np.bincount(y, minlength=2) / max(len(y), 1), 0.01, 0.99)
    usable = np.array([i for i, r in enumerate(rows) if len(r)], dtype=np.int64)
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + 0.3 * epoch)
        order = rng.permutation(usable)
        for block in (order[i : i + LOT] for i in range(0, len(order), LOT)):
            # which windows count is found for a lot of texts together, and holds while these are learned from
            own = np.unique(np.concatenate([rows[i] for i in block]))
            at, inner = _spread(starts[own], size[own])
            gain = np.zeros(len(size))
            gain[own] = _sums(((out[:, 1] - out[:, 0]) @ emb)[bucket[at]], inner)
            windows = [_shown(_window_mean(gain, size, rows[i]), SHOWN if y[i] else 1.0, rng) for i in block]
            for first in range(0, len(block), BATCH):
                lot, best = block[first : first + BATCH], windows[first : first + BATCH]
                chosen = np.concatenate([w for i, b in zip(lot, best) for w in (rows[i][b], rows[i][b + 1])])
                share = np.concatenate([np.tile(1 / np.maximum(size[rows[i][b]] + size[rows[i][b + 1]], LEAST) / len(b), 2) for i, b in zip(lot, best)])
                of = np.repeat(np.arange(len(lot)), [2 * len(b) for b in best])
                own, place = np.unique(chosen, return_inverse=True)
                mix = np.bincount(of * len(own) + place, weights=share, minlength=len(lot) * len(own)).reshape(len(lot), len(own))
                at, inner = _spread(starts[own], size[own])
                unique, place = np.unique(bucket[at], return_inverse=True)
                mean = mix @ _sums(emb[:, unique].T[place], inner)
                error = (softmax(SCALE * (mean @ out) + offset) - np.eye(2)[y[lot]]) * cost[y[lot]][:, None]
                g_out, g_word = SCALE * mean.T @ error, mix.T @ (SCALE * error @ out.T)
                g_emb = np.zeros((len(unique), DIM))
                np.add.at(g_emb, place, np.repeat(g_word, size[own], axis=0))
                seen_emb[unique] += (g_emb**2).sum(axis=1)
                emb[:, unique] -= rate * g_emb.T / np.sqrt(seen_emb[unique])
                seen_out += g_out**2
                out -= 0.1 * rate * g_out / np.sqrt(seen_out)
                offset -= 0.02 * rate * error.sum(axis=0)
    return _calibrated(Model(SCALE * (emb.T @ out), offset), rows, (bucket, starts), y)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of ``n`` from ``first``, and where each run begins among them (one more at the end)."""
    inner = np.r_[0, np.cumsum(n)]
    return np.repeat(first - inner[:-1], n) + np.arange(inner[-1]), inner


def _calibrated(model: Model, rows: list[np.ndarray], bags: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> Model:
    """Shift the offsets so that the best cut between the labels is taken to probability 0.3."""
    if not 0 < y.sum() < len(y):
        return model
    top = pooled(model, rows, bags)
    order = np.argsort(top)
    # errors of each label if all above the cut are predicted toxic
    miss = np.r_[0, np.cumsum(y[order] == 1)] / y.sum()
    false = 1 - np.r_[0, np.cumsum(y[order] == 0)] / (y == 0).sum()
    k = int((miss + FALSE * false).argmin())
    low = top[order[k - 1]] if k > 0 else top[order[0]] - 1
    high = top[order[k]] if k < len(order) else top[order[-1]] + 1
    return Model(model.gain, np.array([0.0, np.log(0.3 / 0.7) - (low + high) / 2]))


def shares(model: Model, texts: list[str | None]) -> np.ndarray:
    """The softmax's share of label 1 for whole texts."""
    words = Words()
    rows = [words.read(t) for t in texts]
    value = pooled(model, rows, words.bags())
    return softmax(np.stack([np.full(len(value), model.offset[0]), value + model.offset[1]], axis=1))[:, 1]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(h, text, y)``: different texts and labels of the bounded sample. A text with several labels counts as toxic if any is 1."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = rows.where("text IS NOT NULL")
    # hashes alone meet the labels and choose the sample; then only its texts move
    keyed = rows.select("_id", F.xxhash64("text").alias("h")).join(marks, "_id").groupBy("h").agg(F.max("y").alias("y"))
    chosen = None
    for y, n in SAMPLE_ROWS.items():
        part = keyed.where(F.col("y") == y).orderBy("h").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    texts = rows.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    return texts.select("h", "text", F.col("y").cast("int").alias("y"))


def fit(rows: DataFrame) -> Model:
    """The model of a bounded :func:`sample`, trained in a task; only its numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        model = train([text for _, text, _ in found], [y for _, _, y in found])
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()]), pa.array([model.offset.tobytes()])], names=["gain", "offset"])

    made = rows.select("h", "text", "y").repartition(1).mapInArrow(run, "gain binary, offset binary").first()
    if made is None:
        return train([], [])
    return Model(np.frombuffer(made["gain"]).reshape(BUCKETS, 2), np.frombuffer(made["offset"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text: the softmax's share of label 1 in the most toxic windows.

    Null, empty and blank texts get the share of an average of nothing. Nothing but the
    text is read; rows with a null id and repeated rows are scored like others.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([ids.schema["id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares(shared.value, b.column(1).to_pylist()))], names=["id", "score"])

    return ids.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels that aren't held out, then score every document: ``held_out``, ``score``, ``predicted``."""
    model = fit(sample(docs.where(~held_out(F.col(id_col))), labels, id_col, text_col))
    found = score(docs, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
