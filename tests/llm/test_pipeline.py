"""The pipeline's stages, each against plain Python on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from meshloom.llm import decontam, secrets, simhash
from meshloom.llm.common import materialize, read_table


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = read_table(spark, data, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data))
        out.append(docs)
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_ids(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    for before, after in zip(steps, steps[1:]):
        assert set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))


def test_language_keeps_texts_with_letters(steps):
    letters = {r.doc_id for r in steps[0].collect() if any(map(str.isalpha, r.text or ""))}
    assert set(ids(steps[1])) <= letters and len(ids(steps[1])) >= 0.97 * len(letters)


def test_one_document_of_each_group(steps):
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in steps[1].collect()}
    group: dict[int, int] = {}
    for i in sorted(fps):
        if i not in group:
            group[i] = i
            todo = [i]
            while todo:
                x = todo.pop()
                new = [j for j in fps if j not in group and (fps[x] ^ fps[j]).bit_count() <= 4]
                group.update(dict.fromkeys(new, i))
                todo += new
    assert sorted(ids(steps[2])) == sorted(set(group.values()))


def test_no_copies_of_the_benchmark_left(spark, data, steps):
    items = [decontam.tokens(r.text) for r in read_table(spark, data, "benchmark").collect()]
    bad = {r.doc_id for r in steps[2].collect() for x in items if decontam.align(x, decontam.tokens(r.text)) >= decontam.LEAK * 2 * len(x)}
    assert set(ids(steps[3])) == set(ids(steps[2])) - bad


def test_no_secrets_left(steps):
    assert sorted(ids(steps[4])) == sorted(ids(steps[3]))
    clean = secrets.digest(secrets.scan(steps[4], [0.0] * secrets.SIZE**2)).collect()
    assert all(r.n_access == 0 and r.n_hex == 0 for r in clean)
    assert all(r.n_chars == len(r.text or "") for r in steps[4].collect())


def test_mix_of_what_is_left(steps):
    source = {r.doc_id: r.source for r in steps[4].collect()}
    taken, target = Counter(), {}
    for r in steps[5].collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert sorted(ids(steps[5])) == sorted(source) and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_run_is_the_stages_together(spark, data, steps):
    want = sorted((r.doc_id, r.taken) for r in steps[5].collect())
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, data).collect()) == want
