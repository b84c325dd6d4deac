"""Cleaning of a corpus in five stages, each an operator of meshloom.llm.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a
DataFrame; each is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common, decontam, langid, mixing, secrets, simhash

#: SQL can't express trained models, fingerprints' components or alignments; tests hold the stages against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows.

    The model is fitted on the documents' own labels. A document goes if it has no letter,
    or if its languages are mixed, so that the best has less than half of the share; a null
    text has no letter. ``lang`` of the kept ones becomes the predicted language. Repeated
    rows are judged each; an empty table, or one without labels, gives an empty one.
    """
    return langid.keep_clear(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of SimHash near-duplicates.

    Null and empty texts are one group. A null id comes last in its group, and of rows with
    one id one stays in each group; an empty table stays empty.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item, whatever their ids; null texts hold none, and repeated rows go or stay together."""
    return decontam.drop_leaks(docs, common.read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; ``n_chars`` follows the text and is null for a null one. Every row stays."""
    model = secrets.train(secrets.samples(docs))
    clean = secrets.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in whole and partial repetitions.

    A null source is one of its own; null texts have size 0. Repeated rows take each their own; an empty table gives an empty result.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secret_scan),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    What a stage wrote on its way, and what it read, is deleted once its result is written.
    """
    docs = common.read_table(spark, sf_dir, "documents")
    since = len(common.written)
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.discard(spark, common.written[since:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
