"""Training-data pipeline: documents to packed training sequences.

Each stage gets the documents its predecessor kept, with all columns of
``documents``; what it decides takes effect. Stages are written below the shared folder
and read again, so a lost executor costs a stage's tasks and no more.

1. toxicity: documents scored 0.5 or more go.
2. ngram_join: of each group of near copies (five-word shingles, similarity of 0.8 or
   more) the document with the smallest id stays.
3. suffix_dedup: every byte in a 200-byte string that starts in two places goes; the
   rest of the text stays, ``n_chars`` is counted anew.
4. decontamination: documents that hold ten successive words of a benchmark item go.
5. packing: a row per piece of a document in a sequence of at most 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netsentry.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from netsentry.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, width=5, num=4, den=5)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_join", keep_first), ("suffix_dedup", remove_repeats),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL has no tokenizer and no iterated components; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "*")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs, name) if n < len(STAGES) - 1 else docs
    return docs
