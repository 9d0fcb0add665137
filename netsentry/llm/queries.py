"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.llm import collocations, context_mixing, decontaminate, embedding_join, html_text, licenses, ngram_join, packing, substring_dedup, token_alignment, token_automaton, toxicity, url_filter
from netsentry.llm.common import id_remainder, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), 0.93)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_examples", "toxic_terms")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return context_mixing.score_texts(docs, F.coalesce(id_remainder(F.col("doc_id"), 7) != 2, F.lit(True)))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90, 100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), url_filter.RULES)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontaminate.leak_report(found)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.score_alignment(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                                           public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = token_automaton.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return token_automaton.decode_ids(coded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents", "text", "lang"), least=30, top=2000)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_license_scan, op4_context_mixing, op5_ngram_join, op6_packing, op7_suffix_dedup, op8_url_filter, op9_decontamination, op10_html_text, op11_token_alignment, op12_token_automaton, op13_collocations)}
QUERIES["pipeline"] = corpus_pipeline.run
