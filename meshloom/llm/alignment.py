"""Alignment of the tokens of two tokenizers by the bytes that they cover.

A batch of texts is one run of bytes: both tokenizers' token ends are counted once by
``bincount`` over it, and a cut is where both occur, so a document's end is one too. Between
two neighbouring ends of either kind lies one link, of the tokens that overlap there. Prefix
sums along the bytes give each token its group and each link its tokens, and their differences
at the documents' ends give what a document has.

Links are counted over the corpus by their pairs of ids, each once a document. A document
without text, or whose tokens of either kind do not have the bytes of a space and its text, has
no tokens. Ids of documents decide nothing, and repeated rows are a document each.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks
from .bytebpe import Numbers, pretokens

#: Files in the folder of public tokenizers.
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk, which is a batch here.
BATCH = 2_000_000
#: Bytes of which ends are counted at once, so that memory is bounded for the longest texts.
WINDOW = 1 << 20
#: Distinct pre-tokens of which a task remembers the ids.
KNOWN = 400_000
DOC_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def paths() -> tuple[str, str]:
    """Where the files of both tokenizers are, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be seen, else those from U+0100 on, in order."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Tokens(NamedTuple):
    """A tokenizer's token bytes by id, and for each id its decimal digits with ``,``, ``|`` or ``;`` behind."""

    data: pa.LargeBinaryArray
    sizes: np.ndarray
    digits: pa.LargeBinaryArray


def _tokens(data: list[bytes]) -> _Tokens:
    digits = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(len(data))]
    return _Tokens(pa.array(data, pa.large_binary()), np.array([len(x) for x in data], np.int64), pa.array(digits, pa.large_binary()))


class ByteLevel:
    """The byte-level tokenizer: pre-tokens that a task has met before are not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        byte = _byte_of_letter()
        self.tokens = _tokens([bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1)])
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.sizes = Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if len(self.numbers) > KNOWN:
            self.forget()
        codes = [self.numbers.of(pretokens(x)) for x in texts]
        new = list(itertools.islice(self.numbers, len(self.sizes), None))
        found = [e.ids for e in self.own.encode_batch_fast(new, add_special_tokens=False)]
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found))])
        flat = np.concatenate([np.zeros(0, np.uint32), *codes])
        ends = np.cumsum([0, *map(len, codes)])
        sizes = self.sizes[flat]
        ids = chunks.ragged(self.ids, (np.cumsum(self.sizes) - self.sizes)[flat], sizes)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][ends])


class Pieces:
    """The tokenizer of pieces, with bytes for what it has no piece for."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = _tokens([self._bytes(i) for i in range(self.own.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.own.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.own.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = self.own.encode(texts, num_threads=1)
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


@lru_cache(maxsize=2)
def tokenizers(a: str | None = None, b: str | None = None) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once a process."""
    first, second = paths() if not (a and b) else (a, b)
    return ByteLevel(a or first), Pieces(b or second)


class Aligned(NamedTuple):
    """Groups and links of a batch. ``group_*`` is a token's group, ``link_*`` the token's number at a link; ``links`` the ends of documents among links."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> Aligned:
    """Align tokens of given numbers of bytes, all over 0, of documents that end at the bytes ``ends``.

    Both kinds cover all bytes. Empty documents end where the one before does.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total = int(ends[-1]) if len(ends) else 0
    group_a, group_b, link_a, link_b, links = [], [], [], [], []
    cuts = n_a = n_b = n_links = 0
    for low in range(0, total, window):
        high = min(low + window, total)
        own_a = ends_a[np.searchsorted(ends_a, low, "right") : np.searchsorted(ends_a, high, "right")] - low - 1
        own_b = ends_b[np.searchsorted(ends_b, low, "right") : np.searchsorted(ends_b, high, "right")] - low - 1
        at_a, at_b = np.bincount(own_a, minlength=high - low), np.bincount(own_b, minlength=high - low)
        cut = at_a & at_b
        before = cuts + np.cumsum(cut) - cut
        group_a.append(before[own_a])
        group_b.append(before[own_b])
        either = at_a | at_b
        at = np.flatnonzero(either)
        link_a.append((n_a + np.cumsum(at_a) - at_a)[at])
        link_b.append((n_b + np.cumsum(at_b) - at_b)[at])
        own = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high, "right")] - low - 1
        links.append(n_links + np.cumsum(either)[own])
        cuts, n_a, n_b, n_links = cuts + int(cut.sum()), n_a + len(own_a), n_b + len(own_b), n_links + len(at)
    none = np.zeros(0, np.int64)
    leading = np.zeros(int(np.searchsorted(ends, 0, "right")), np.int64)  # documents that end at byte 0
    return Aligned(*(np.concatenate([none, *x]) for x in (group_a, group_b, link_a, link_b)), np.concatenate([leading, *links]))


def _same(tokens: _Tokens, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text have its bytes together."""
    joined = tokens.data.take(pa.array(ids, pa.int64()))
    at = np.r_[0, np.cumsum(tokens.sizes[ids])][np.r_[0, np.cumsum(counts)]].tolist()
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    return np.array([len(x) == b - a and data[a:b] == x for x, a, b in zip(texts, at[:-1], at[1:])], bool)


def batch(texts: list[str], a: str | None = None, b: str | None = None) -> dict[str, object]:
    """Groups and links of texts: lists of a value a text, and under ``pairs`` the links' pairs of ids, ``a << 32 | b``, in order."""
    first, second = tokenizers(a, b)
    whole = [(" " + x).encode() for x in texts]
    ids_a, n_a = first.encode([" " + x for x in texts])
    ids_b, n_b = second.encode(texts)
    good = np.array([bool(x) for x in texts], bool) & _same(first.tokens, ids_a, n_a, whole) & _same(second.tokens, ids_b, n_b, whole)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    ends = np.cumsum([len(x) if ok else 0 for x, ok in zip(whole, good)])
    found = align(first.tokens.sizes[ids_a], second.tokens.sizes[ids_b], ends)

    in_a, in_b = np.bincount(found.group_a), np.bincount(found.group_b)
    last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)  # tokens up to a group's end
    place_a = np.arange(len(ids_a)) + (last_b - in_b)[found.group_a]
    place_b = np.arange(len(ids_b)) + last_a[found.group_b]
    shown = np.empty(len(ids_a) + len(ids_b), np.int64)  # groups' tokens, A's and then B's, as numbers into both tables of digits
    end_a = np.bincount(last_a - 1, minlength=len(ids_a)).astype(bool)
    end_b = np.bincount(last_b - 1, minlength=len(ids_b)).astype(bool)
    shown[place_a] = ids_a + len(first.tokens.sizes) * end_a
    shown[place_b] = ids_b + len(second.tokens.sizes) * (2 * end_b) + len(first.tokens.digits)
    text = pa.chunked_array([first.tokens.digits, second.tokens.digits]).combine_chunks().take(pa.array(shown))
    at = np.frombuffer(text.buffers()[1], np.int64)[: len(shown) + 1] if len(shown) else np.zeros(1, np.int64)
    bounds = at[np.r_[0, np.cumsum(n_a + n_b)]].tolist()
    data = memoryview(text.buffers()[2] or b"")
    sha = [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:])]
    groups = np.searchsorted(last_a, np.cumsum(n_a), "right")  # up to each document's end
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(np.r_[0, groups]), "n_links": np.diff(np.r_[0, found.links]),
        "groups_sha256": sha, "pairs": ids_a[found.link_a].astype(np.int64) << 32 | ids_b[found.link_b].astype(np.int64),
    }


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Chunk table of the links of every text, written; packs hold ``pairs`` and how many documents of the chunk have each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = chunks.parts_of(rows)
    of = chunks.schema(rows.schema["id"].dataType, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string", "pairs array<long>, docs array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = chunks._arrow(of)
        for chunk, ids, texts in chunks.slices(batches, BATCH):
            got = batch(texts, a, b)
            pairs, number, count = np.unique(got["pairs"], return_inverse=True, return_counts=True)
            rank = np.empty(len(pairs), np.int64)  # frequent pairs get small numbers, which take less room
            rank[np.argsort(-count, kind="stable")] = np.arange(len(pairs))
            number, pairs = rank[number], pairs[np.argsort(rank)]
            doc = np.repeat(np.arange(len(ids)), got["n_links"])
            held = np.bincount(np.unique(number * len(ids) + doc) // max(len(ids), 1), minlength=len(pairs))
            part = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            ends = np.cumsum(got["n_links"])[:-1]
            counted = [got[c].tolist() for c in DOC_COLUMNS[:4]] + [got["groups_sha256"]]
            rest = (None,) * 3
            made = [(chunks.DOC, i, chunks.squeeze(c), None, *n, None, None) for i, c, n in zip(ids, np.split(number, ends), zip(*counted))]
            made.append((chunks.DEAL, None, chunks.squeeze(part), None, None, None, *rest, None, None))
            made += [(chunks.PACK, None, None, p, None, None, *rest, pairs[at], held[at].astype(np.int32)) for p, at in chunks.deal(part)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made), arrow.types[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(made), arrow.types[0]), *columns], schema=arrow)

    return chunks.write(rows, run, of)


def pair_counts(table: DataFrame) -> DataFrame:
    """``(pair, docs, best, dealt)`` of every pair of ids that is linked: how many documents hold it, whether no pair of its A id is in more, and its part."""
    packs = table.where(f"kind = {chunks.PACK}").select(F.col("part").alias("dealt"), F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = packs.groupBy(F.col("x.pairs").alias("pair"), "dealt").agg(F.sum("x.docs").alias("docs"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"), "dealt")


def count_packs(table: DataFrame) -> DataFrame:
    """``(chunk, part, docs, best)``: corpus-wide counts of each pack's pairs; a part's packs and counts meet in one group, and parts grow in number with the input."""
    packs = table.where(f"kind = {chunks.PACK}").select("chunk", "part", "pairs")

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pairs, docs = right.column("pair").to_numpy(), right.column("docs").to_numpy()
        best = right.column("best").to_numpy()
        at = [np.searchsorted(pairs, x.values.to_numpy()) for x in left.column("pairs")]
        return pa.table({
            "chunk": left.column("chunk"), "part": left.column("part"),
            "docs": pa.array([docs[k].tolist() for k in at], pa.list_(pa.int64())), "best": pa.array([np.packbits(best[k]).tobytes() for k in at], pa.binary()),
        })

    return packs.groupBy("part").cogroup(pair_counts(table).groupBy("dealt")).applyInArrow(look_up, "chunk long, part int, docs array<long>, best binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """A row for each text: its tokens, groups and links, and by the corpus-wide counts ``n_best`` and ``count_sum``.

    ``a`` and ``b``: files of the byte-level and of the piece tokenizer, on every machine.
    """
    table = aligned(docs, id_col, text_col, a, b)

    def finish(rows: pa.Table, codes: list[np.ndarray], packs: pa.Table, places: np.ndarray) -> dict:
        none = np.zeros(0, np.int64)
        count, best = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        by_pack = [x.values.to_numpy() for x in packs.column("docs")]
        count[places] = np.concatenate([none, *by_pack])
        best[places] = np.concatenate([none, *(np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(n)) for x, n in zip(packs.column("best"), by_pack))])
        flat, ends = np.concatenate([none, *codes]).astype(np.int64), np.cumsum([0, *map(len, codes)])
        sums = {k: np.diff(np.r_[0, np.cumsum(v[flat])][ends]) for k, v in (("n_best", best), ("count_sum", count))}
        return {c: rows.column(c) for c in ("id", *DOC_COLUMNS)} | {k: pa.array(v) for k, v in sums.items()}

    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    of = T.StructType([T.StructField("id", table.schema["id"].dataType), *longs, T.StructField("groups_sha256", T.StringType())])
    return chunks.gather(table, count_packs(table), DOC_COLUMNS, finish, of).withColumnRenamed("id", "doc_id")
