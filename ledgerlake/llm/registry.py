"""Queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import fingerprints, html_text, mixing, packing, quality_model, quality_rules, similarity_join, substring_dedup, token_counts, url_filters
from ledgerlake.llm.common import table
from ledgerlake.llm.native_words import words


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Domains of the labelled table, and the share of all tokens that each should have.
DOMAIN_WEIGHTS = {"clean": 0.90, "toxic": 0.02, "low": 0.08}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: low for quality 0, else toxic or clean."""
    return labels.where("quality in (0, 1) and toxic in (0, 1)").select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(words(F.col("text")), " "), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: (verdict, host, path prefix)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the labelled documents whose lines it holds: blocked if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages")
    bad = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    told = url_filters.label_pages(pages.select("page_id", "html"), table(spark, sf_dir, "documents"), bad)
    found = url_filters.filter_urls(pages, told, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.link(table(spark, sf_dir, "documents"), shingle=3, percent=90, lower=True).drop("text_key")


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filters, op3_quality_rules, op4_mixing, op5_substring_dedup, op6_html_extraction, op7_token_counts, op8_fingerprints, op9_quality_classifier, op10_ngram_jaccard_join)}
ORACLE_SQL = {"op3_quality_rules": quality_rules.ORACLE}
