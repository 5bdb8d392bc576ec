"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillgrid.llm import (
    decontamination, html_extraction, language_id, licences, near_duplicates, packing, prefix_trie, quality, secrets, token_files, toxicity,
    url_filter, vector_codes)
from tillgrid.llm.common import read_table
from tillgrid.llm.tokens import tokenizer_path
from tillgrid.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(read_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    rows = token_files.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)
    token_files.write_tokens(rows, path)
    return token_files.token_digests(spark, path)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_on(pages))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(read_table(spark, sf_dir, "documents"), percent=85)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_language_id, op4_quality_rules, op5_decontamination, op6_secret_scan,
                                    op7_licence_scan, op8_token_files, op9_url_filter, op10_near_duplicates, op11_html_extraction,
                                    op12_vector_codes, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.SQL, "op9_url_filter": url_filter.SQL,
            "op10_near_duplicates": near_duplicates.SQL, "op12_vector_codes": vector_codes.SQL, "op13_prefix_trie": prefix_trie.SQL}
