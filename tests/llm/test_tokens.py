"""Byte-level BPE and alignment of tokens, held against the tokenizers' own libraries and plain Python."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from meshloom.llm import alignment, bytebpe, chunks, queries

SHA = lambda b: hashlib.sha256(b).hexdigest()
ODD = [
    None, "", " ", "\n\n  \n x", "don't they'LL 'S  's", "a" * 30_000, " " * 5_000 + "x", "É\x00  😀 é 　\x85\x1c\x1f 1²३", "<|endoftext|> <s></s> <unk> <0x41> ▁ ▁▁a",
    "Same words here, the same words.", "Same words here, the same words.", "tab\tand\r\nlines\x0b\x0c", "ﬁ Å ｆｕｌｌ ​﻿", "word salad goes on " * 4_000, " lead and trail ",
]


def plain_ids(texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t or "") for t in texts], {i: b for b, i in ranks.items()}


def letters():
    """Byte of each letter of byte-level vocabularies."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain_alignment(texts):
    """Rows of the alignment without ids, by loops."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        name = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = letters()
    rows, linked = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in name[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append([0, 0, 0, 0, ""])
            linked.append([])
            continue
        span_a = np.cumsum([0, *map(len, bytes_a)]).tolist()
        span_b = np.cumsum([0, *map(len, bytes_b)]).tolist()
        cuts = sorted(set(span_a[1:]) & set(span_b[1:]))
        groups, at = [], [0, 0]
        for cut in cuts:
            ends = [span_a.index(cut, at[0]), span_b.index(cut, at[1])]
            groups.append("|".join(",".join(map(str, ids[i:j])) for ids, i, j in zip((ids_a, ids_b), at, ends)))
            at = ends
        links, j = [], 0
        for i in range(len(ids_a)):
            while span_b[j + 1] <= span_a[i]:
                j += 1
            k = j
            while k < len(ids_b) and span_b[k] < span_a[i + 1]:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        rows.append([len(ids_a), len(ids_b), len(cuts), len(links), SHA(";".join(groups).encode())])
        linked.append(links)
    count = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [tuple(r) + (sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x)) for r, x in zip(rows, linked)]


def table(spark, texts, n=3):
    docs = spark.createDataFrame([(None if i == 1 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs.selectExpr("*", "1 AS id", "2 AS part", "3 AS chunk", "4 AS codes", "5 AS kind", "6 AS ids").repartition(n)


def encoded_rows(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect())


def test_ids_and_bytes_as_the_library_has_them(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for frame, got in ((docs, queries.op11_byte_bpe(spark, data)), (table(spark, ODD), None)):
        rows = frame.select("doc_id", "text").collect()
        ids, token = plain_ids([r.text for r in rows])
        got = got or bytebpe.digest(bytebpe.decode(bytebpe.encode(frame)))
        want = sorted((-1 if r.doc_id is None else r.doc_id, len(x), SHA(" ".join(map(str, x)).encode()), SHA((r.text or "").encode())) for r, x in zip(rows, ids))
        assert all(b"".join(token[i] for i in x) == (r.text or "").encode() for r, x in zip(rows, ids))
        assert encoded_rows(got) == want


def test_long_texts_are_split_alike(monkeypatch):
    whole = [list(bytebpe.pretokens(t or "")) for t in ODD]
    monkeypatch.setattr(bytebpe, "LONG", 10)
    assert [list(bytebpe.pretokens(t or "")) for t in ODD] == whole and ["".join(x) for x in whole] == [t or "" for t in ODD]


def test_pretokens_of_all_characters():
    """Every character of the first plane, and many beyond it, is split, alone and in runs, as both libraries split it."""
    first = alignment.tokenizers()[0]
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 23))]
    texts = [" ".join(f"a{c}b{c}1{c} {c}! {c}{c}  {c}x" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    ids, _ = plain_ids(texts)
    own = bytebpe._encoding(bytebpe.ranks_path())
    assert [[i for w in bytebpe.pretokens(t) for i in own.encode_ordinary(w)] for t in texts] == ids
    got, sizes = first.encode(texts)
    assert got.tolist() == [i for e in first.own.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids] and sizes.sum() == len(got)


def test_decoding_of_any_ids(spark):
    rows = [(1, [464, 3290], "x"), (2, [], "y"), (3, None, "z"), (4, [464, 99_999], None), (5, [-1], "w"), (6, [None, 464], "v"), (None, [3290, 464], "u")]
    got = bytebpe.decode(spark.createDataFrame(rows, "k int, ids array<int>, decoded string").repartition(2))
    assert got.columns == ["k", "ids", "decoded"]
    want = {1: b"The dog", 2: b"", 3: None, 4: None, 5: None, 6: None, None: b" dogThe"}
    assert {r.k: None if r.decoded is None else bytes(r.decoded) for r in got.collect()} == want


def test_chunks_decide_nothing(spark, monkeypatch):
    docs = table(spark, ODD, 1)
    want = encoded_rows(bytebpe.digest(bytebpe.decode(bytebpe.encode(docs))))
    other = sorted(map(str, alignment.digest(docs).collect()))
    parts = chunks.parts_of
    monkeypatch.setattr(chunks, "parts_of", lambda d: 3 * parts(d) + 1)
    docs = table(spark, ODD, 7)
    assert encoded_rows(bytebpe.digest(bytebpe.decode(bytebpe.encode(docs)))) == want
    assert sorted(map(str, alignment.digest(docs).collect())) == other


def test_slices_of_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunks, "CHUNK", 10)
    monkeypatch.setattr(chunks, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("D", (), {"partitionId": staticmethod(lambda: 2)}))}))
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 4, None, "b" * 30])], names=["i", "t"]), pa.RecordBatch.from_arrays([pa.array([4]), pa.array(["c"])], names=["i", "t"])]
    assert list(chunks.slices(iter(batches))) == [(2 << 32, [1, 2, 3], ["aaaa", "", "b" * 30]), ((2 << 32) + 1, [4], ["c"])]


def rows_of(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in frame.collect())


def test_alignment_by_loops(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for frame, got in ((docs, queries.op12_token_alignment(spark, data)), (table(spark, ODD), None)):
        rows = frame.select("doc_id", "text").collect()
        want = sorted((-1 if r.doc_id is None else r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows])))
        assert rows_of(got or alignment.digest(frame)) == want
        assert sum(r[1] > 0 for r in want) > len(want) / 3


@pytest.mark.parametrize("window", [1, 3, 7, 1000])
def test_windows_of_bytes(window):
    rng = np.random.default_rng(window)
    docs = [int(n) for n in rng.integers(0, 40, 60)] + [0, 0]
    docs[0] = 0
    cut = lambda n: np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), n]) if n else np.zeros(0, int)
    a, b = (np.concatenate([cut(n) for n in docs]) for _ in range(2))
    whole, parts = alignment.align(a, b, np.cumsum(docs)), alignment.align(a, b, np.cumsum(docs), window)
    assert all((x == y).all() for x, y in zip(whole, parts))
    span = lambda s: list(zip(np.cumsum(s) - s, np.cumsum(s)))
    links = sorted((i, j) for i, (p, q) in enumerate(span(a)) for j, (r, s) in enumerate(span(b)) if p < s and r < q)
    assert links == list(zip(parts.link_a.tolist(), parts.link_b.tolist()))
    assert parts.links[-1] == len(links) and parts.links[0] == 0
