"""Language-model scores by a hidden Markov model.

States emit word classes, by the hash of a word's last characters; a class emits its words
by their training counts. Baum-Welch steps are Spark jobs: each task runs forward and
backward over its texts, and expected counts, which have a fixed size, are summed over the
partitions. A text's likelihood is exact: class sequences by the scaled forward recursion,
words by a join with the counts of all training words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .wordhash import mix, words

STATES = 6
#: Word classes, and one more that only ends a text.
CLASSES = 2048
#: Bytes of a word's end, hashed to its class; longer ends tell more, shorter ones are shared more.
SUFFIX = 4
STEPS = 3
#: Tokens, about, that run through the recursions together.
LOT = 400_000
#: Tokens that a task holds at once.
CHUNK = 1_000_000

_INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


@dataclass
class Model:
    """Shares: of first states, from state to state, and of classes by state."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokenize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes of the words of a text, A-Z lower-cased; the end is not among them."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    starts, ends, h = words(data, _INSIDE)
    tail = np.zeros(len(h), np.uint64)
    for k in range(1, SUFFIX + 1):
        at = ends - k
        tail = tail * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(h) else tail
    return h, (mix(tail) % np.uint64(CLASSES)).astype(np.int16)


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate([np.zeros(0, rows[0].dtype if rows else np.int64), *rows])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in rows])], pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame) -> DataFrame:
    """``(kind, chunk, id, at, held_out, classes, word, cls, rows, counts, train_n)`` from ``(id, row, held_out, text)``.

    Texts are numbered (``at``) within a chunk. Rows of kind 0 are texts with their classes.
    Rows of kind 1 are the words of a chunk: in which of its texts each is, how often, and
    how often in training ones. A word's rows are as many as the chunks it is in, however
    common it is.
    """
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("at", T.IntegerType()), T.StructField("held_out", T.BooleanType()),
         T.StructField("classes", T.ArrayType(T.ShortType())), T.StructField("word", T.LongType()), T.StructField("cls", T.ShortType()),
         T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("train_n", T.LongType())]
    )
    names = schema.names
    arrow = {"classes": pa.list_(pa.int16()), "word": pa.int64(), "cls": pa.int16(), "rows": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "train_n": pa.int64()}

    def chunk(ids: pa.Array, row: pa.Array, out: pa.Array, got: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, own = len(got), row[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, own)), ids, pa.array(np.arange(n, dtype=np.int32)), out, _lists([c for _, c in got], pa.int16()),
             *(pa.nulls(n, arrow[k]) for k in names[6:])], names=names
        )
        h = np.concatenate([h for h, _ in got])
        if not len(h):
            return
        cls = np.concatenate([c for _, c in got])
        text = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x, _ in got])
        order = np.argsort(h, kind="stable")
        h, cls, text = h[order], cls[order], text[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        times = np.diff(np.r_[new, len(h)])
        h, cls, text = h[new], cls[new], text[new]
        word = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        training = ~out.to_numpy(zero_copy_only=False)[text]
        offsets = pa.array(np.r_[word, len(h)], pa.int32())
        m = len(word)
        rows = pa.ListArray.from_arrays(offsets, pa.array(text, pa.int32()))
        counts = pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, own)), pa.nulls(m, ids.type), pa.nulls(m, pa.int32()), pa.nulls(m, out.type), pa.nulls(m, arrow["classes"]),
             pa.array(h[word].view(np.int64)), pa.array(cls[word]), rows, counts, pa.array(np.add.reduceat(times * training, word).astype(np.int64))],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, size = 0, [], 0
            for k in range(b.num_rows):
                held.append(tokenize(b.column(3)[k].as_py()))
                size += len(held[-1][0])
                if size >= CHUNK or k + 1 == b.num_rows:
                    yield from chunk(*(b.column(j).slice(at, len(held)) for j in range(3)), held)
                    at, held, size = k + 1, [], 0

    return docs.mapInArrow(run, schema)


class Lot:
    """Class sequences, each closed by the end, laid out step by step: longer ones first, so that those still running are the first of a step."""

    def __init__(self, seqs: list[np.ndarray]) -> None:
        seqs = [np.r_[s, np.int16(CLASSES)] for s in seqs]
        length = np.array([len(s) for s in seqs])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        steps = np.arange(length[0])
        self.running = len(seqs) - np.searchsorted(length[::-1], steps, side="right")
        self.begin = np.r_[0, np.cumsum(self.running)]
        flat = np.concatenate([seqs[i] for i in self.order])
        row = np.repeat(np.arange(len(seqs)), length)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        self.seen, self.row = np.empty(len(flat), np.int16), np.empty(len(flat), np.int32)
        at = self.begin[step] + row
        self.seen[at], self.row[at] = flat, row

    def forward(self, model: Model, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward vectors and scales of all steps."""
        emit = np.ascontiguousarray(model.emit.T, kind)[self.seen]
        move, alpha, scale = model.move.astype(kind), np.empty((len(emit), STATES), kind), np.empty(len(emit), kind)
        for k, n in enumerate(self.running):
            at = slice(self.begin[k], self.begin[k] + n)
            now = (alpha[self.begin[k - 1] : self.begin[k - 1] + n] @ move if k else model.first.astype(kind)) * emit[at]
            scale[at] = np.maximum(now.sum(axis=1), 1e-30)
            alpha[at] = now / scale[at, None]
        return emit, alpha, scale

    def expected(self, model: Model, sums: list[np.ndarray]) -> None:
        """Add the expected counts to ``sums``: of first states, of moves, and of classes by state."""
        emit, alpha, scale = self.forward(model, np.float32)
        ahead, back = emit / scale[:, None], np.ascontiguousarray(model.move.T, np.float32)
        beta = np.ones_like(alpha)
        for k in range(len(self.running) - 1, 0, -1):
            n, b, before = self.running[k], self.begin[k], self.begin[k - 1]
            ahead[b : b + n] *= beta[b : b + n]
            beta[before : before + n] = ahead[b : b + n] @ back
        gamma = alpha * beta
        gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30)
        n = self.running[0]
        sums[0] += gamma[:n].sum(axis=0)
        last = np.arange(n, len(alpha)) - np.repeat(self.running[:-1], self.running[1:])  # the step before, of the same row
        sums[1] += model.move * (alpha[last].T @ ahead[n:])
        for s in range(STATES):
            sums[2][s] += np.bincount(self.seen, weights=gamma[:, s], minlength=CLASSES + 1)


def _lots(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of the sequences, like lengths together, in lots of about LOT tokens."""
    lot, size = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: len(seqs[i])):
        lot.append(i)
        size += len(seqs[i]) + 1
        if size >= LOT:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def baum_welch(texts: DataFrame, steps: int = STEPS, seed: int = 11) -> Model:
    """Train on ``classes`` of all rows, whole: ``steps`` rounds of expected counts, summed over the partitions.

    Without a row the model stays as it was drawn.
    """
    rng = np.random.default_rng(seed)
    spread = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.dirichlet(np.full(shape[-1], 2.0), shape[:-1] or None))
    model = Model(np.full(STATES, 1 / STATES), 0.9 * np.eye(STATES) + 0.1 / STATES, spread(STATES, CLASSES + 1))
    context = texts.sparkSession.sparkContext
    for _ in range(steps):
        shared = context.broadcast(Model(*(x.astype(np.float32) for x in (model.first, model.move, model.emit))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1))]
            for b in batches:
                seqs = [x.values.to_numpy(zero_copy_only=False) for x in b.column(0)]
                for lot in _lots(seqs):
                    Lot([seqs[i] for i in lot]).expected(shared.value, sums)
            flat = np.concatenate([s.ravel() for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

        got = texts.select("classes").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(STATES * (1 + STATES + CLASSES + 1))
        for r in got:
            flat[r["at"]] = r["n"]
        shared.unpersist()
        if not flat.any():
            break
        model = maximized(flat[:STATES], flat[STATES : STATES * (1 + STATES)].reshape(STATES, STATES), flat[STATES * (1 + STATES) :].reshape(STATES, -1))
    return model


def maximized(first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Model of expected counts; a little of every class's overall share is put into each state's."""
    every = emit.sum(axis=0) + 0.5
    emit = emit + 2.0 * CLASSES * every / every.sum() * 0.05
    return Model(*(x / x.sum(axis=-1, keepdims=True) for x in (first + 1, move + 1, emit)))


def log_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of whole class sequences (the end left out, and added here), by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for lot in _lots(seqs):
        laid = Lot([seqs[i] for i in lot])
        scale = laid.forward(model, np.float64)[2]
        out[np.array(lot)[laid.order]] = np.bincount(laid.row, weights=np.log10(scale), minlength=len(lot))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the documents that aren't held out (crc32 of the id, remainder 2 of 7).
    Null, empty and blank texts are an end alone. Repeated rows are learned from and scored
    each; null ids are not held out. Words are told apart by 64-bit hashes. Without training
    texts all counts are 0 and the model stays as it was drawn.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    coded = materialize(encode(rows))
    texts = coded.where("kind = 0").select("chunk", "at", "id", "held_out", "classes")
    postings = coded.where("kind = 1").select("chunk", "word", "cls", "rows", "counts", "train_n")
    counts = postings.groupBy("word").agg(F.sum("train_n").alias("c"), F.first("cls").alias("cls"))
    counts = materialize(counts.where("c > 0"))
    by_class = np.zeros((2, CLASSES))
    for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        by_class[:, r["cls"]] = r["n"], r["v"]
    ends = texts.where("NOT held_out").count()
    total, types = int(by_class[0].sum()) + ends, int(by_class[1].sum()) + (ends > 0)
    model = baum_welch(texts.where("NOT held_out"))

    # known words: their counts; of the words of a text, each adds its own
    known = postings.join(counts.select("word", "c"), "word")
    per_text = (
        known.select("chunk", F.explode(F.arrays_zip("rows", "counts")).alias("x"), "c")
        .groupBy("chunk", F.col("x.rows").alias("at"))
        .agg(F.sum("x.counts").alias("n_known"), F.sum(F.col("x.counts") * F.log10(F.col("c") + 1)).alias("log_counts"))
    )
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(by_class.sum(axis=0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, size = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                seqs = [x.values.to_numpy(zero_copy_only=False) for x in b.column(4)]
                ll = log_likelihood(m, seqs) - np.array([size[s].sum() for s in seqs])
                n = np.array([len(s) + 1 for s in seqs], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), pa.array(n), pa.array(ll)], names=["chunk", "at", "id", "held_out", "n_tokens", "ll"])

    schema = T.StructType([*(texts.schema[c] for c in ("chunk", "at", "id", "held_out")), T.StructField("n_tokens", T.LongType()), T.StructField("ll", T.DoubleType())])
    scored = texts.mapInArrow(run, schema).join(per_text, ["chunk", "at"], "left")
    log_counts = F.coalesce("log_counts", F.lit(0.0))
    known_end = F.lit(1 if ends else 0)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.coalesce("n_known", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (log_counts + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))).alias("base_score"),
        (F.col("ll") + log_counts).alias("score"),
    )
