"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import htmltext, langid, quality
from lexquarry.llm.alignment import align_tokens
from lexquarry.llm.convtrie import conversation_trie
from lexquarry.llm.decontam import decontaminate
from lexquarry.llm.imatch import fingerprints_of_edits
from lexquarry.llm.license import scan_licenses
from lexquarry.llm.mixing import mix_sources
from lexquarry.llm.neardup import near_duplicates
from lexquarry.llm.neighbours import nearest
from lexquarry.llm.spark import table
from lexquarry.llm.substring import repeated_substrings
from lexquarry.llm.urlfilter import filter_urls

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), URL_RULES, carry=("page_id",))
    return out.selectExpr("page_id", "_host as host", "_path as path", "_rule as rule", "_verdict as verdict")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, one_in=20, carry=("doc_id",))
    return out.selectExpr("doc_id", "_n_words as n_words", "_n_hit as n_hit", "_n_items as n_items", "_items_sha256 as items_sha256", "_contaminated as contaminated")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model, carry=("doc_id",))
    return out.select("doc_id", quality.is_held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, at_least=(85, 100)).drop("class_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_substrings(table(spark, sf_dir, "documents"), window=50, carry=("doc_id",))
    return out.selectExpr("doc_id", "_n_words as n_words", "_n_removed as n_removed", "_kept_sha256 as kept_sha256")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs), carry=("doc_id",))
    return out.select("doc_id", langid.is_held_out("doc_id").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return out.selectExpr("doc_id", "_n_words as n_words", "_n_base as n_base", "_first_word as first_word", "_last_word as last_word", "_base_labels as base_labels", "_labels as labels", "_score as score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3, carry=("doc_id",))
    return out.selectExpr("doc_id", "_size as size", "_source_size as source_size", "_target as target", "_taken as taken", "_copies as copies")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract_pages(table(spark, sf_dir, "pages"), htmltext.train(), carry=("page_id", "url"))
    return out.selectExpr("page_id", "url", "_text as text", "_n_chars as n_chars")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return out.selectExpr("doc_id", "_n_a as n_a", "_n_b as n_b", "_n_groups as n_groups", "_n_links as n_links", "_n_best as n_best", "_count_sum as count_sum", "_groups_sha256 as groups_sha256")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_benchmark_decontamination, op3_quality_classifier, op4_minhash_near_dedup, op5_substring_dedup,
        op6_document_fingerprints, op7_language_id, op8_license_scans, op9_source_mixing, op10_html_extraction, op11_tokenizer_alignment, op12_nearest_neighbours, op13_conversation_trie,
    )
}
