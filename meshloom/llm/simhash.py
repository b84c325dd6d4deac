"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Cut into three segments, two fingerprints that differ
in at most four bits have a segment that differs in at most one. Each segment is
indexed once for each of its bits, with that bit left out; equal keys are
candidates, and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize

#: (first bit, number of bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
SEED = 42
#: Keys with up to so many fingerprints are compared pair by pair, larger ones by a search that leaves out what is linked already.
SMALL = 24
#: Keys with more fingerprints are cut up by their other bits before the search.
LARGE = 4096


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the ``shingle``-word shingles of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    h = np.array(hashes, dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` of every document; ``fp`` holds the 64 bits as a signed long.

    A null text counts as empty; empty and blank texts get 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def variant_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: 64 keys for each fingerprint, a segment less one of its bits each."""
    keys = []
    for first, n in SEGMENTS:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << n) - 1))
        for bit in range(n):
            left = segment.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << bit)))
            keys.append(left.bitwiseOR(F.lit((first + bit) << 32)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(a: np.ndarray, b: np.ndarray, bit: int) -> np.ndarray:
    """Whether a pair differs in few bits, and ``bit`` is the first key that the two share."""
    x = a ^ b
    ok = np.bitwise_count(x) <= MAX_BITS
    open_ = np.ones(x.shape, dtype=bool)  # no earlier segment would do
    for first, n in SEGMENTS:
        part = (x >> np.uint64(first)) & np.uint64((1 << n) - 1)
        ones = np.bitwise_count(part)
        if first <= bit < first + n:
            here = (part == np.uint64(1 << (bit - first))) | ((part == 0) & (bit == first))
            return ok & open_ & here
        open_ &= ones > 1
    raise ValueError(bit)


def _search(fp: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a large key connects: a tree for each connected part."""
    left, out = fp, []
    while len(left) > 1:
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            block, front = front[:32], front[32:]
            hit = _linked(block[:, None], left[None, :], bit).any(axis=0)
            new, left = left[hit], left[~hit]
            out.append((np.full(len(new), root), new))
            front = np.concatenate([front, new])
    return out


def _connect(fp: np.ndarray, bit: int, free: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links as of :func:`_search`, of many fingerprints: of the bits ``free``, cut into five parts, linked ones share a part.

    So each part's groups of equal bits are searched by themselves; those that hold most of
    the fingerprints, as near copies do, at once, others in turn by their own free bits.
    """
    if len(fp) <= LARGE or len(free) <= MAX_BITS:
        return _search(fp, bit)
    out = []
    for part in np.array_split(free, MAX_BITS + 1):
        bits = fp & np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(bits, kind="stable")
        bits, own = bits[order], fp[order]
        rest = [b for b in free if b not in part]
        bounds = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                out += _connect(own[a:b], bit, rest) if b - a <= len(fp) // 2 else _search(own[a:b], bit)
    return out


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of equal keys; the rows come sorted by key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    bits = (key[starts] >> 32).astype(np.int64)
    found = []
    for k in np.flatnonzero(sizes > SMALL):
        bit = int(bits[k])
        outside = [b for first, n in SEGMENTS if not first <= bit < first + n for b in range(first, first + n)]
        found += _connect(fp[starts[k] : starts[k] + sizes[k]], bit, outside)
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    key, fp = key[small], fp[small]
    for step in range(1, SMALL):
        if step >= len(key):
            break
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        a, b = fp[same], fp[same + step]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        a, b, bit = a[near], b[near], (key[same[near]] >> 32).astype(np.int64)
        for k in np.unique(bit):
            at = bit == k
            ok = _linked(a[at], b[at], int(k))
            found.append((a[at][ok], b[at][ok]))
    if not found:
        return np.array([], np.uint64), np.array([], np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key, which may go on

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _links(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if key[0] == key[-1] and (not held or held[-1][0][-1] == key[0]):
            held.append((key, fp))
            continue
        cut = int(np.searchsorted(key, key[-1]))
        rows = [*held, (key[:cut], fp[:cut])]
        held = [(key[cut:], fp[cut:])]
        yield out(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))
    if held:
        yield out(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))


def near_links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that connect all within four bits of each other.

    A key that many fingerprints share gives a tree of links instead of all its pairs:
    what is connected stays connected, with no more rows than the key has.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few and small as they are, the fingerprints are dealt over all tasks, as each gives 64 keys
    keys = variant_keys(fps.select("fp").where("fp IS NOT NULL").distinct().repartition(n, F.xxhash64("fp")))
    dealt = keys.repartition(n, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link_batches, "a long, b long")


def _placed(of_docs: DataFrame, lowest: Column) -> DataFrame:
    """``(fp, low, root)`` of every fingerprint: an aggregate of its rows, and its component."""
    low = of_docs.groupBy("fp").agg(lowest.alias("low"))
    roots = connected_components(near_links(of_docs))
    return low.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row for each document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links of at most four
    differing bits, the document's own included. Null texts count as empty; all empty
    texts have fingerprint zero and are linked. Repeated rows stay, each with the same
    result. A null id is never the smallest unless a component has no other. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    of_docs = materialize(fingerprints(docs, id_col, text_col, shingle))
    placed = _placed(of_docs, F.min("id"))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return of_docs.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id, all columns kept.

    Rows are told apart by a number that is written with them, not by id: different texts
    under one id, or under none, are each kept if they are first in their groups. A null id
    is first only in a group without any other; of equal ids one row is first.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    texts = numbered.select(F.struct(F.col("doc")[id_col].isNull().alias("none"), F.col("doc")[id_col].alias("id"), "row").alias("key"), F.col("doc")[text_col].alias("text"))
    placed = _placed(materialize(fingerprints(texts, "key", "text")), F.min("id"))
    first = placed.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row").alias("row"))
    return numbered.join(first, "row", "left_semi").select("doc.*")
