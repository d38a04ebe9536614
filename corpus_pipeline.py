"""A training corpus from raw documents: language, copies, near copies, source mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a table; the next one reads it from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import bpe, exact_dedup, language, mixing, near_dedup
from holdfast.session import scratch_path, tune

VOCABULARY = "word_bpe_49k.json"
#: Words of a shingle of the near-duplicate stage (op7_near_dedup has four by its contract).
NEAR_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text shows; those without letters or a likely language go."""
    tune(spark)
    model = language.learn(docs, public_tokenizers.path(VOCABULARY))
    return language.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    tune(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates: shingles of five words, similarity 0.8 or more."""
    tune(spark)
    return near_dedup.drop_near_copies(docs, words=NEAR_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    tune(spark)
    return mixing.mix_sources(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the text that the ids decode to."""
    tune(spark)
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), outputs=("ids", "n_tokens", "decoded"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe", tokenize),
]

#: The language and near-duplicate stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
