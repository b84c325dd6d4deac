"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of a test item are its pairs of neighbouring words, which a text holds if the
two words follow each other in it, with at most one word between. An alignment that scores
a leak keeps at least :func:`need` of them within twice the item's length. So the most
frequent ones, counted over all texts, fewer than that together, can be left out: any leak
has one of the rest, and these rare ones are the seeds that join texts to items. Where a
text has a seed and enough of the item's other pairs near by, the passage is aligned word by
word. The score is that of the best local alignment over what the whole item would score, so
edited, extended and paraphrased copies count by what they keep in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .wordhash import grams, mix, words

#: Items of up to so many words are one seed as a whole, and must occur as they are.
SHORT = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's full score that is a leak.
LEAK = 0.5
#: Words of test items that are broadcast at once (40 bytes each). More items are taken in blocks, each against all texts.
BLOCK_GRAMS = 1_000_000
#: Low bits of an n-gram's hash that are looked up first.
MAYBE_BITS = 22

#: Punctuation beyond ASCII, which parts words as ASCII's does.
_MARKS = re.compile("[\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u301f\uff01-\uff0f\uff1a-\uff20]")
#: Letters, digits and all bytes of longer characters make words.
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: lower-cased runs of letters and digits."""
    low = (text or "").lower()
    low = low if low.isascii() else _MARKS.sub(" ", low)
    return words(np.frombuffer(low.encode("utf-8", "surrogatepass"), dtype=np.uint8), _INSIDE)[2]


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Score of the best local alignment of two word sequences."""
    n = len(passage)
    last, best = np.zeros(n + 1, np.int64), 0
    slope = GAP * np.arange(n + 1)
    for w in item:
        row = np.zeros(n + 1, np.int64)
        np.maximum(last[:-1] + np.where(passage == w, MATCH, MISMATCH), last[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - slope) + slope  # gaps within the row
        best = max(best, int(row.max()))
        last = row
    return best


def pairs(h: np.ndarray, step: int = 1) -> np.ndarray:
    """Hash of every word with the one ``step`` words on."""
    return mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else np.zeros(0, np.uint64)


def need(n: int) -> int:
    """Pairs that every leak of an item of ``n`` words keeps, at one or two words' distance.

    Of the score 2n a leak may lose 2n (1 - LEAK). A word that is replaced or left out costs 3
    and breaks two pairs; one cut off at an end costs 2 and breaks one; two words put in
    between cost 2 and break one. So at most two pairs are broken for each 3 that are lost.
    """
    return 1 if n <= SHORT else max(n - 1 - int(MATCH * n * (1 - LEAK) * 2 / 3 + 1e-9), 1)


class Seeds:
    """Items of one block, bounded by BLOCK_GRAMS, and where each of their n-grams is known: sorted hashes, and for each item its own, with how often it has them."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.items, self.need = items, [need(len(x)) for x in items]
        self.sizes = sorted({len(x) for x in items if len(x) <= SHORT})
        found = [np.unique(grams(x, len(x)) if len(x) <= SHORT else pairs(x), return_counts=True) for x in items]
        self.gram = np.unique(np.concatenate([g for g, _ in found]))
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)  # which low bits a known n-gram has, asked before the search
        self.maybe[self.gram & np.uint64(len(self.maybe) - 1)] = True
        self.own = [np.searchsorted(self.gram, g) for g, _ in found]
        self.weight = [n for _, n in found]
        self.choose(np.zeros(len(self.gram), np.int64))

    def choose(self, count: np.ndarray) -> None:
        """Make the rarest n-grams of each item its seeds: as many as it takes that what is left can't make a leak without them."""
        item, gram = [], []
        for k, (own, weight) in enumerate(zip(self.own, self.weight)):
            order = np.argsort(-count[own], kind="stable")  # the most frequent first, which may be left out
            rare = own[order[np.cumsum(weight[order]) >= self.need[k]]]
            item.append(np.full(len(rare), k))
            gram.append(rare)
        gram_, item_ = np.concatenate(gram), np.concatenate(item)
        order = np.argsort(gram_, kind="stable")
        self.rare = item_[order]
        self.first = np.searchsorted(gram_[order], np.arange(len(self.gram) + 1))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``w`` of all known n-grams, and their numbers."""
        every = [grams(w, n) for n in self.sizes] + [pairs(w, 1), pairs(w, 2)]
        found = []
        for g in every:
            pos = np.flatnonzero(self.maybe[(g & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.gram, g[pos]), len(self.gram) - 1)
            ok = self.gram[at] == g[pos]
            found.append((pos[ok], at[ok]))
        return np.concatenate([p for p, _ in found]), np.concatenate([a for _, a in found])

    def count(self, text: str | None) -> np.ndarray:
        """Numbers of the known n-grams in a text, once for each time that it has them."""
        return self.hits(tokens(text))[1]

    def score(self, text: str | None) -> list[tuple[int, int, float]]:
        """``(item, seeds, score)`` of every item that ``text`` holds a leak of."""
        w = tokens(text)
        pos, at = self.hits(w)
        order = np.argsort(at, kind="stable")
        pos, at = pos[order], at[order]
        seen, begin = np.unique(at, return_index=True)
        begin = np.r_[begin, len(at)]
        out = []
        for k in np.unique(self.rare[_spread(self.first[seen], self.first[seen + 1])]).tolist():
            own, weight, item = self.own[k], self.weight[k], self.items[k]
            place = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
            here = seen[place] == own
            if weight[here].sum() < self.need[k]:
                continue
            place, which = place[here], np.flatnonzero(here)
            p = pos[_spread(begin[place], begin[place + 1])]
            r = np.repeat(which, begin[place + 1] - begin[place])
            order = np.argsort(p, kind="stable")
            p, r = p[order], r[order]
            reach = 2 * len(item)
            sums = np.r_[0, np.cumsum(weight[r])]
            stop = np.searchsorted(p, p + reach)  # a leak's n-grams begin within so many words
            dense = np.flatnonzero(sums[stop] - sums[:-1] >= self.need[k])
            best, n, next_ = 0.0, 0, 0
            while next_ < len(dense):  # windows that overlap are one passage
                last = next_
                while last + 1 < len(dense) and dense[last + 1] < stop[dense[last]]:
                    last += 1
                lo, hi = dense[next_], stop[dense[last]]
                next_ = last + 1
                inside = np.unique(r[lo:hi])
                if weight[inside].sum() < self.need[k]:
                    continue
                passage = w[max(p[lo] - reach, 0) : p[hi - 1] + reach]
                best = max(best, align(item, passage) / (MATCH * len(item)))
                n = max(n, len(inside))
            if best >= LEAK:
                out.append((k, n, best))
        return out


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each ``first`` to before its ``last``."""
    n = last - first
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words)`` of every item with a word; arrays of hashes. Items of one text stay apart by id."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["item"], T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [tokens(x.as_py()) for x in b.column(1)]
            values = np.concatenate([np.zeros(0, np.uint64), *w]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in w])], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["item", "words"])

    return rows.mapInArrow(run, schema).where("size(words) > 0")


def _blocks(items: DataFrame, texts: DataFrame) -> Iterator[tuple[pa.Array, Seeds]]:
    """Ids and seeds of the items, in blocks of about BLOCK_GRAMS words. How rare an n-gram is, is counted over all ``texts``."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_GRAMS))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)
        rows = block.distinct().toArrow()
        if rows.num_rows:
            seeds = Seeds([x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in rows.column("words")])
            seeds.choose(_counts(texts, seeds))
            yield rows.column("item").combine_chunks(), seeds


def _counts(texts: DataFrame, seeds: Seeds) -> np.ndarray:
    """How often all texts have each n-gram of a block of items: as many numbers as the block has n-grams."""
    shared = texts.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value.gram), np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(shared.value.count(x.as_py()), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(seeds.gram), np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    shared.unpersist()
    return out


def _block(docs: DataFrame, ids: pa.Array, seeds: Seeds, item: T.StructField) -> DataFrame:
    """Leaks of one block of items, as :func:`leaks` returns them. Each text is searched by the task that reads it."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, seeds))
    schema = T.StructType([docs.schema["id"], item, T.StructField("n_seeds", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds = shared.value
        for b in batches:
            found = [(row, *hit) for row, x in enumerate(b.column(1)) for hit in seeds.score(x.as_py())]
            if found:
                row, k, n, score = zip(*found)
                cols = [b.column(0).take(pa.array(row)), ids.take(pa.array(k)), pa.array(n, pa.int64()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", item.name, "n_seeds", "score"])

    return docs.mapInArrow(run, schema)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs of a document and a test item that it holds a copy of: ids, ``n_seeds``, ``score`` (LEAK to 1).

    Whole texts are searched, and the result is that of aligning every text with every
    item; items of up to SHORT words must occur as they are. ``n_seeds`` are the item's
    distinct pairs of neighbouring words that the passage has. Null, empty and wordless texts and items give no row; an
    empty table on either side gives an empty result. Repeated rows give one row a pair,
    as do rows that share an id; null ids count as one id. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    known = materialize(item_words(items, item_col, item_text_col))
    found = None
    for ids, seeds in _blocks(known, rows.select("text")):
        part = _block(rows, ids, seeds, known.schema["item"])
        found = part if found is None else found.union(part)
    if found is None:
        schema = T.StructType([rows.schema["id"], known.schema["item"]]).add("n_seeds", T.LongType()).add("score", T.DoubleType())
        found = docs.sparkSession.createDataFrame([], schema)
    found = found.groupBy("id", "item").agg(F.max("n_seeds").alias("n_seeds"), F.max("score").alias("score"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_seeds", F.round("score", 6).alias("score"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item, whatever their ids and their other columns' names are."""
    text = f"c{docs.columns.index(text_col)}"
    left = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    known = materialize(item_words(items))
    for _, seeds in _blocks(known, left.select(text)):
        left = _without(left, seeds, text)
    return left.toDF(*docs.columns)


def _without(docs: DataFrame, seeds: Seeds, text: str) -> DataFrame:
    """The rows without a leak of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.score(x.as_py()) for x in b.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
