"""The corpus pipeline: civil, good, distinct documents, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run()
writes each result as Parquet into the shared folder, reads it back for the next, and removes what
a stage wrote in between. All but the last return the columns of documents, whatever further
columns those are and however they are named. A table without rows gives one without rows at every
stage; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, mixing, neardup, quality, toxicity
from marlstone.llm._shared import remove, scratch_path, scratch_until_end, table

TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows among docs, does not call toxic (a score of 0.5 or more).

    Null, empty and blank texts have the score of the bias, the share of toxic labels, and stay
    while that is below a half. Rows with one text, or one id, are judged alike by their texts.
    """
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls good: a posterior of a half or more, given text, source and language.

    Null and empty texts are judged as empty ones. A null source or language is a group of its own.
    A posterior of exactly a half stays.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by shingles of five words and a similarity of 0.8.

    Rows without words are in no group and stay. Of rows with one id, or none, any one stays.
    """
    return neardup.keep_first(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix to weights 1, 2, 3, ... takes them.

    Texts without words have no size and are not taken. A null source is one of its own. Rows that
    share an id, or are equal, count each.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each document in the mix; a null or empty text has no ids, and repeated rows stay repeated."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality_classifier", reject_poor),
    ("minhash_near_dedup", keep_distinct),
    ("mixing_sources", mix_sources),
    ("bpe_encoding", encode),
]

#: Fitted models and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, scratch_path(spark, name)
        with scratch_until_end(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
    return docs
