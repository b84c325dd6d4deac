"""Documents in chunks, and the distinct values that a chunk's documents hold.

A chunk is a run of whole documents of one task. Its documents keep their values as numbers
local to the chunk; a distinct value leaves the chunk once, in a pack with the others of its
part (a hash of the value), and what is found out about it comes back to the chunk as a pack.
So what is shuffled grows with distinct values a chunk and not with occurrences, and no value
holds more than one entry a chunk, however common it is.

A chunk table has the rows of three kinds. ``DOC``: ``id`` and ``codes``, the numbers of its
values in order. ``DEAL``: one a chunk, ``codes`` are the parts of its values by number.
``PACK``: a part's values of the chunk, by number. An operator adds columns of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshloom.session import shared_dir

from . import common

DOC, DEAL, PACK = 0, 1, 2
#: A chunk is closed once its texts have so many characters; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Parts for each of the input's partitions: a part holds about a quarter of the distinct values of a partition.
PARTS = 4


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**32 - 1 as compressed bytes: first the lowest byte of all, then the next."""
    return zstandard.compress(np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def loosen(data: bytes) -> np.ndarray:
    """What :func:`squeeze` was given."""
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def squeeze_words(words: list[str]) -> tuple[bytes, bytes]:
    """Texts as compressed bytes, one after another, and their numbers of bytes."""
    data = [w.encode() for w in words]
    return zstandard.compress(b"".join(data), 3), squeeze(np.fromiter(map(len, data), np.uint32, len(data)))


def loosen_words(data: bytes, sizes: bytes) -> list[str]:
    """What :func:`squeeze_words` was given."""
    whole, ends = zstandard.decompress(data), np.cumsum(loosen(sizes)).tolist()
    return [whole[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]


def parts_of(docs: DataFrame) -> int:
    """How many parts the values of ``docs`` are dealt to: in proportion to its partitions."""
    return PARTS * max(docs.rdd.getNumPartitions(), 4)


def schema(id_type: T.DataType, doc: str, pack: str) -> T.StructType:
    """Of a chunk table with the columns ``doc`` of documents and ``pack`` of packs, as DDL."""
    fixed = T.StructType.fromDDL("chunk long, kind int, codes binary, part int").fields
    return T.StructType([*fixed[:2], T.StructField("id", id_type), *fixed[2:], *T.StructType.fromDDL(f"{doc}, {pack}" if doc else pack).fields])


def slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, list, list[str]]]:
    """``(chunk, ids, texts)`` of whole documents, from batches of an id and a text; a null text is empty.

    Chunk numbers differ between tasks. ``most``: characters of a chunk, CHUNK if None.
    """
    most = most or CHUNK
    first = TaskContext.get().partitionId() << 32
    n, size, ids, texts = 0, 0, [], []
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield first + n, ids, texts
                n, size, ids, texts = n + 1, 0, [], []
    if ids:
        yield first + n, ids, texts


def deal(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part, and the numbers of its values."""
    order = np.argsort(parts, kind="stable")
    bounds = np.flatnonzero(np.r_[True, parts[order][1:] != parts[order][:-1], True]) if len(parts) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield int(parts[order[a]]), order[a:b]


def write(docs: DataFrame, run: Callable, of: T.StructType) -> DataFrame:
    """The chunk table that ``run`` makes of ``docs``, written to the shared folder.

    It is bucketed by chunk, so that packs come back to it without a shuffle of its documents.
    The name in the catalog is only needed to read the buckets' layout.
    """
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    buckets = 2 * max(docs.rdd.getNumPartitions(), 4)
    made = docs.mapInArrow(run, of)
    made.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    common.written.append(path)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def gather(table: DataFrame, answers: DataFrame, doc: list[str], finish: Callable, of: T.StructType) -> DataFrame:
    """Bring answers, ``(chunk, part, ...)`` rows of one a pack and in its order, back to the chunks' documents.

    ``finish(documents, codes, packs, places)`` makes the rows of the schema ``of``: ``documents`` has
    ``id`` and the columns ``doc``, ``codes`` their numbers, ``packs`` the answers by part, and entry
    ``i`` of the packs, one after another, belongs to the value numbered ``places[i]``.
    """
    left = table.where(f"kind < {PACK}").select("chunk", "kind", "id", "codes", *doc)
    names, arrow = of.fieldNames(), _arrow(of)

    def run(key: tuple, docs: pa.Table, packs: pa.Table) -> pa.Table:
        kind = docs.column("kind").to_numpy()
        dealt = docs.filter(pa.array(kind == DEAL)).column("codes")
        places = np.argsort(np.concatenate([loosen(x.as_py()) for x in dealt]), kind="stable")
        docs = docs.filter(pa.array(kind == DOC))
        codes = [loosen(x.as_py()) for x in docs.column("codes")]
        made = finish(docs.select(["id", *doc]), codes, packs.sort_by("part"), places)
        return pa.table([made[n] for n in names], names=names).cast(arrow)

    return left.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, of)


def _arrow(of: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(of)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i] : starts[i] + sizes[i]]``, one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
