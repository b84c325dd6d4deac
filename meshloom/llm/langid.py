"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary logistic classifier of hashed
byte n-grams predicts the codeword's bit; decoding weighs each bit's loss by how well its
classifier did in training, chooses the nearest codeword, and flags a text as ambiguous
if the second-nearest is almost as near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lowest

#: Labelled documents that the classifiers are fitted on at most, of different texts, those of lowest hash.
SAMPLE_ROWS = 3000
#: Number of hashed n-gram features.
FEATURES = 1 << 12
#: Lengths of the n-grams, in bytes of the lower-cased text.
GRAMS = (1, 2, 3)
STEPS = 150
#: A text is ambiguous if the best language's share is lower.
CLEAR = 0.6


@dataclass
class Model:
    """Languages, their codewords in -1 and 1, and for each bit weights, offset and worth."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    worth: np.ndarray


def features(text: str) -> np.ndarray:
    """Square-rooted shares of hashed n-grams of a whole text, scaled to length 1."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES)
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h *= np.uint32(0x9E3779B1)
                h += data[k : len(data) - n + 1 + k]
            h *= np.uint32(0x85EBCA6B)
            counts += np.bincount(h >> np.uint32(20), minlength=FEATURES)
    root = np.sqrt(counts)
    return (root / max(np.linalg.norm(root), 1e-9)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` languages in -1 and 1: all distinct splits of few, random splits of many."""
    if n <= 5:
        splits = [[1, *(1 - 2 * (k >> b & 1) for b in range(n - 1))] for k in range(1, 1 << (n - 1))]
    else:
        rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
        splits = []
        while len(splits) < bits:
            split = rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)).tolist()
            splits.append(split)
    return np.array(splits or [[1]]).T


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most SAMPLE_ROWS of the documents with a language and a text.

    Features are counted by Spark's tasks; a fixed number of numbers a sampled row comes
    to the driver. Without labelled rows the model knows no language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = lowest(rows, ["text", "lang"], SAMPLE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x.as_py()).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], names=["x", "lang"])

    got = rows.mapInArrow(run, "x binary, lang string").collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1), np.ones(1))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    code = codewords(len(langs))
    y = code[[langs.index(r["lang"]) for r in got]].astype(np.float32)
    w, b = np.zeros((FEATURES, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        g = -y / (1 + np.exp(y * (x @ w + b))) / len(x)
        gw = x.T @ g + 1e-5 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * g.sum(axis=0)
    right = ((x @ w + b) * y > 0).mean(axis=0)
    return Model(langs, code, w, b, np.clip(2 * right - 1, 0.05, 1))


def decode(model: Model, x: np.ndarray) -> np.ndarray:
    """Share of each language for rows of features: a softmax of the weighted loss against each codeword."""
    margin = x @ model.weight + model.offset
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None, :, :])
    total = (loss * model.worth).sum(axis=2)
    total -= total.min(axis=1, keepdims=True)
    share = np.exp(-total)
    return share / share.sum(axis=1, keepdims=True)


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """``(kept, lang_pred, score, ambiguous)`` from ``(kept, text)``."""
    schema = T.StructType(
        [rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each bit of the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = b.column(1).to_pylist()
                known = [bool(m.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
                lang, score, unclear = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if any(known):
                    where = np.flatnonzero(known)
                    share = decode(m, np.stack([features(texts[i]) for i in where]))
                    for i, k in zip(where, share.argmax(axis=1)):
                        lang[i] = m.langs[k]
                    score[where] = share.max(axis=1)
                    unclear[where] = share.max(axis=1) < CLEAR
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)], names=["kept", "lang_pred", "score", "ambiguous"]
                )

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``lang_pred``, ``score`` and ``ambiguous``.

    ``score`` is the language's share. Whole texts are used, and nothing but texts. A null text, and one without a letter, is
    ``und`` with score 0 and not ambiguous; so is every text if the model knows no language. Repeated rows and null ids stay.
    """
    found = _predicted(docs.select(F.col(id_col).alias("kept"), F.col(text_col).alias("text")), model)
    return found.withColumnRenamed("kept", id_col)


def keep_clear(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language has a share of ``least``, which becomes their ``lang_col``; all columns, whatever their names, stay.

    Rows that are ``und`` (null texts, and those without a letter) go. Repeated rows are judged each.
    """
    found = _predicted(docs.select(F.struct("*").alias("kept"), F.col(text_col).alias("text")), model)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(F.col("kept").withField(lang_col, F.col("lang_pred").cast(docs.schema[lang_col].dataType)).alias("kept")).select("kept.*")


def held_out(df: DataFrame, parts: int, part: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out (remainder 1 of 3), then predict all; with ``held_out``."""
    model = fit(docs.where(~held_out(docs, 3, 1, id_col)), text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select(id_col, held_out(found, 3, 1, id_col).alias("held_out"), "lang_pred", "score", "ambiguous")
