"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshloom.llm import common, decontam, hmm, langid, mixing, queries, quality, secrets, simhash, toxicity, urlfilter
from meshloom.llm.common import connected_components, lowest, materialize

LONG = "word salad goes on and on " * 20_000
TEXTS = [None, "", "   \n\t ", "one", "same text here again", "same text here again", LONG, "É\x00\u2028 😀 token = abcdefghijklmnop", "\n\n\n", "a" * 100_000]
CLASH = (
    "id", "row", "fp", "base", "spans", "_text", "key", "h", "score", "size", "gram", "root", "part", "kept", "_kept", "doc", "_leaked", "lang_pred", "ambiguous",
    "assign", "access", "hexes", "_token", "_at", "token", "at", "c0", "c1", "y", "_id", "x", "block", "whole", "target", "taken", "held_out", "kind", "chunk", "words", "n.o",
)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all here", "en", "a", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[F.lit("x").alias(c) for c in CLASH]).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (3, 1, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", "<p>x, y.</p>"), (1, "http://a.org/x", "<p>x, y.</p>"), (2, None, None), (None, "", ""), (3, "a://B.com/de/é?", "<" * 50_000)],
                          "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, "same text here again"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [1.0]), (7, [-3.0, 0.25])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    frame.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "cell", "n", "component", "n.o")]).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, edge_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_rows(name, spark, edge_dir):
    got = queries.queries()[name](spark, edge_dir).collect()
    if name == "op5_decontamination":
        assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(4, 1, 1.0), (5, 1, 1.0)]
    elif name == "op13_whitening":
        assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == sorted((i, c, 4) for i in (0, 1, 1, 7) for c in (1, 2))
    else:
        table = "pages" if name.startswith(("op8", "op9")) else "documents"
        assert len(got) == spark.read.parquet(f"{edge_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(name, spark, edge_dir, empty_dir):
    got = queries.queries()[name](spark, empty_dir)
    assert got.count() == 0 and got.columns == queries.queries()[name](spark, edge_dir).columns


def test_near_duplicates_of_odd_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert got[4] == got[5] and len(got[4]) == 1
    for i in (0, 1, 2, 8):
        assert got[i] == {("0" * 16, 0)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and ids.count(4) == 1 and 0 in ids


def test_components_of_chains_and_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (201, 200)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(e).collect())
    assert {got[i] for i in range(41)} == {0} and got[201] == got[200] == 200
    assert connected_components(e.where("false")).count() == 0


def test_sample_is_bounded_and_distinct(spark):
    df = spark.range(1000).select((F.col("id") % 300).alias("x"))
    assert lowest(df, ["x"], 50).count() == 50 and lowest(df, ["x"], 500).count() == 300
    assert lowest(df.where("false"), ["x"], 5).count() == 0


def test_null_source_is_its_own(spark, edge_dir):
    got = mixing.mix(spark.read.parquet(f"{edge_dir}/documents.parquet")).collect()
    assert all(r.taken == 0 for r in got if r.size == 0) and len({r.target for r in got}) <= 3


def test_quality_of_empty_texts(spark, edge_dir):
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(spark.read.parquet(f"{edge_dir}/documents.parquet"))).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept and got[9].word_chars == 100_000


def test_secrets_keep_other_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    clean = secrets.redact(docs, secrets.train(secrets.samples(docs)))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("doc_id = 7").first().text == "É\x00\u2028 😀 [SECRET]"


def test_toxicity_is_learned_in_a_task(spark):
    texts = [f"text {i} {'you creature' if i % 2 else 'of calm rivers'}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = toxicity.sample(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    got = sorted((r.h, r.text, r.y) for r in rows.collect())
    want = toxicity.train([t for _, t, _ in got], [y for _, _, y in got])
    model = toxicity.fit(rows)
    assert len(got) == 40 and (model.gain == want.gain).all() and (model.offset == want.offset).all()


def test_models_without_samples(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.predict(ask, langid.fit(none)).first().lang_pred == "und"
    assert 0 <= toxicity.score(ask, toxicity.train([], [])).first().score <= 1
    assert hmm.score(none.select("doc_id", "text")).count() == 0
    assert decontam.leaks(ask, none.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_rules_with_nulls_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    rules = spark.createDataFrame([("b", "/c", "allow"), ("b", "/c", "block"), (None, "/c", "allow"), ("a.b", None, "allow"), ("b", "/", "allow")], "host string, path string, verdict string")
    r = urlfilter.judge(pages, rules).first()
    assert (r.rule, r.verdict) == ("b/c", "block")


def test_pipeline_of_odd_rows(spark, edge_dir):
    """Stage by stage: what goes, and that other columns stay, whatever their names."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, edge_dir))
        assert docs.columns == spark.read.parquet(f"{edge_dir}/documents.parquet").columns, name
        texts.append(sorted((r.doc_id, r.text) for r in docs.fillna(-1).collect()))
    assert all(any(map(str.isalpha, t or "")) for _, t in texts[0]) and {i for i, _ in texts[0]} <= {-1, 3, 4, 5, 6, 7, 9}
    same = [i for i, t in texts[0] if t == TEXTS[4]]
    assert [i for i, t in texts[1] if t == TEXTS[4]] == same[:1]
    assert texts[2] == [(i, t) for i, t in texts[1] if t != TEXTS[4]]
    assert [i for i, _ in texts[3]] == [i for i, _ in texts[2]] and all("abcdefghijklmnop" not in t for _, t in texts[3])
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir).collect()
    assert len(mixed) == len(texts[3]) and all(r.taken <= 2 * r["size"] for r in mixed)


def test_pipeline_of_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_leaves_one_folder(spark, edge_dir):
    before = len(common.written)
    got = corpus_pipeline.run(spark, edge_dir)
    assert len(common.written) == before + 2 and got.count() > 0  # the last stage's own, and what it reads
    common.discard(spark, common.written[before:])


def test_clear_language_stays(spark):
    rows = [(1, "plain words one"), (1, "plain words one"), (None, "plain words two"), (2, None), (3, "12")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'x' AS lang", "1 AS score", "2 AS ambiguous", "3 AS lang_pred", "4 AS kept")
    got = langid.keep_clear(docs, langid.fit(docs))
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.score, r.kept) for r in got.collect()) == [(0, 1, 4), (1, 1, 4), (1, 1, 4)]
