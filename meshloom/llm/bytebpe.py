"""Byte-level BPE, encoding and decoding, by a global shuffle of distinct words.

Texts are split into pre-tokens. Each distinct one of a chunk of documents is shuffled by its
hash, encoded once wherever it comes from, and its ids are joined back to the chunk; the
positions of its occurrences, which stay in the chunk, put each text's ids in order. Decoding
joins ids with the table of the tokens' bytes, which is as small as the vocabulary.

A null text counts as empty and has no ids. Ids of documents, nulls and repeats among them,
decide nothing: every row is encoded by itself. A text, however long, is one row.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks

#: File of ranks, in the folder of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"
#: Ids that are decoded at once, or those of one row.
AT_ONCE = 1 << 18
#: Texts of more characters are split one match at a time.
LONG = 4_000_000


def ranks_path() -> str:
    """Where the file of ranks is, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a file of ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def splitter(pattern: str | None = None) -> regex.Pattern:
    """The pattern that splits texts into pre-tokens; None: that of the public tokenizers."""
    import public_tokenizers

    return regex.compile(pattern or public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=splitter().pattern, mergeable_ranks=ranks(path), special_tokens={})


def pretokens(text: str) -> Iterable[str]:
    """The matches of the pattern in a text, in order; they cover it."""
    if len(text) > LONG:
        return (m.group() for m in splitter().finditer(text))
    return splitter().findall(text)


class Numbers(defaultdict):
    """A number for each distinct key, in order of first use."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__

    def of(self, keys: Iterable) -> np.ndarray:
        """The keys' numbers."""
        return np.fromiter(map(self.__getitem__, keys), np.uint32, len(keys) if isinstance(keys, list) else -1)


def distinct_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk table of the pre-tokens of every text, written; packs hold ``words`` and their ``lengths``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts, of = chunks.parts_of(rows), chunks.schema(rows.schema["id"].dataType, "", "words binary, lengths binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = chunks._arrow(of)
        for chunk, ids, texts in chunks.slices(batches):
            numbers = Numbers()
            codes = [chunks.squeeze(numbers.of(pretokens(x))) for x in texts]
            words = list(numbers)
            part = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % parts
            made = [(chunks.DOC, i, c, None, None, None) for i, c in zip(ids, codes)]
            made.append((chunks.DEAL, None, chunks.squeeze(part), None, None, None))
            made += [(chunks.PACK, None, None, p, *chunks.squeeze_words([words[k] for k in at.tolist()])) for p, at in chunks.deal(part)]
            columns = [pa.array(c, t) for c, t in zip(zip(*made), arrow.types[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(made), arrow.types[0]), *columns], schema=arrow)

    return chunks.write(rows, run, of)


def encode_packs(table: DataFrame, path: str | None = None) -> DataFrame:
    """``(chunk, part, sizes, ids)``: of each pack, how many ids its words have, and the ids.

    All packs of a part meet in one task, part after part, so a distinct word is encoded once.
    """
    packs = table.where(f"kind = {chunks.PACK}").select("chunk", "part", "words", "lengths").repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path or ranks_path()).encode_ordinary
        known, now = {}, None
        for batch in batches:
            sizes, ids = [], []
            for part, data, lengths in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                if part != now:
                    known, now = {}, part
                words = chunks.loosen_words(data, lengths)
                for w in words:
                    if w not in known:
                        known[w] = encode(w)
                found = [known[w] for w in words]
                sizes.append(chunks.squeeze(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(chunks.squeeze(np.fromiter(itertools.chain.from_iterable(found), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "part", "sizes", "ids"])

    return packs.mapInArrow(run, "chunk long, part int, sizes binary, ids binary")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids)``: the token ids of every text, in order. ``path``: file of ranks, on every machine."""
    table = distinct_words(docs, id_col, text_col)

    def finish(rows: pa.Table, codes: list[np.ndarray], packs: pa.Table, places: np.ndarray) -> dict:
        none = np.zeros(0, np.uint32)
        by_pack = np.concatenate([none, *(chunks.loosen(x.as_py()) for x in packs.column("sizes"))]).astype(np.int64)
        ids = np.concatenate([none, *(chunks.loosen(x.as_py()) for x in packs.column("ids"))])
        sizes, starts = np.empty_like(by_pack), np.empty_like(by_pack)
        sizes[places], starts[places] = by_pack, np.cumsum(by_pack) - by_pack
        found = [chunks.ragged(ids, starts[c], sizes[c]) for c in codes]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([none, *found]).astype(np.int32)
        return {"id": rows.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

    of = T.StructType([T.StructField("id", table.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return chunks.gather(table, encode_packs(table, path), [], finish, of)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.LargeBinaryArray:
    """The bytes of each token, by id; null where no token has the id."""
    found = {i: token for token, i in ranks(path).items()}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.large_binary())


def decode(encoded: DataFrame, ids_col: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that the tokens of ``ids_col`` have together, in the column ``to``.

    Null for null ids, and where an id has no token. The table of bytes is bounded by the
    vocabulary, so every task holds it, and its join is a look-up of a batch's ids at once;
    bytes come out in the ids' order, of which each row takes its own stretch.
    """
    of = T.StructType([f for f in encoded.schema if f.name != to] + [T.StructField(to, T.BinaryType())])
    rows = encoded.select(*[F.col(f"`{f.name}`") for f in of if f.name != to])

    def joined(batch: pa.RecordBatch, table: pa.LargeBinaryArray) -> pa.RecordBatch:
        ids = batch.column(batch.schema.get_field_index(ids_col))
        flat, ends = ids.flatten(), np.cumsum(np.r_[0, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]).tolist()
        known = flat.fill_null(-1).to_numpy().astype(np.int64)
        fits = (known >= 0) & (known < len(table))
        found = table.take(pa.array(np.where(fits, known, 0)))
        at = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        data = memoryview(found.buffers()[2] or b"")
        lost = np.cumsum(np.r_[0, ~fits | ~found.is_valid().to_numpy(zero_copy_only=False)])
        out = [None if null or lost[b] > lost[a] else bytes(data[at[a] : at[b]]) for a, b, null in zip(ends[:-1], ends[1:], ids.is_null().to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=of.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path or ranks_path())
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(ids_col)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes) // AT_ONCE).tolist()
            first = 0
            for k in range(1, len(part) + 1):
                if k == len(part) or part[k] != part[first]:
                    yield joined(batch.slice(first, k - first), table)
                    first = k

    return rows.mapInArrow(run, of)


def digest(encoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoded and decoded texts."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
