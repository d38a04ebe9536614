"""Named queries of the operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, exact_dedup, html_text, language, lexical_search, line_dedup, mixing, near_dedup, neighbours, sentence_pieces, sharding, token_alignment, url_rules
from holdfast.llm.common import table
from holdfast.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(tune(spark), folder, "documents"))


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.url_verdicts(table(tune(spark), folder, "pages"))


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(tune(spark), folder, "documents"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.line_bitmaps(table(tune(spark), folder, "documents"), keep_text=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(table(tune(spark), folder, "documents"), path, outputs=outputs).select("doc_id", *outputs)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(tune(spark), folder, "documents"))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(table(tune(spark), folder, "documents"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(tune(spark), folder, "embeddings"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(tune(spark), folder, "documents")
    model = language.learn(docs, public_tokenizers.path("word_bpe_49k.json"))
    rows = docs.select("doc_id", "text", language.held_out("doc_id").alias("held_out"))
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(table(tune(spark), folder, "pages"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(tune(spark), folder, "documents"), *paths)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank(table(tune(spark), folder, "documents"), table(spark, folder, "benchmark"))


def op13_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return sentence_pieces.encode(table(tune(spark), folder, "documents"), path, outputs=outputs).select("doc_id", *outputs)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(tune(spark), folder)


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_mix_sources": op3_mix_sources,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_language": op9_language,
    "op10_html_text": op10_html_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentence_pieces": op13_sentence_pieces,
    "pipeline": pipeline,
}
