"""A corpus made ready for training: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, mixing, quality, simhash, toxicity
from sparkloom.llm.common import clear, mark, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    A null or empty text is judged as a text without words, a long one whole; equal texts stay or go together. Rows with
    null or repeated ids stay as they are, and so do columns of any name. An empty table, or none with labels, loses no row.
    """
    return toxicity.keep_civil(docs, _labels(spark, sf_dir), threshold=0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is judged by the model's bias, a long one whole; equal texts stay or go together. Rows with null
    or repeated ids stay as they are, and so do columns of any name. An empty table, or one without labels, loses no row.
    """
    return quality.keep_good(docs, _labels(spark, sf_dir), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null last; of repeated rows one.

    Null, empty and blank texts are one group; long texts are compared whole. Columns of any name stay. An empty table
    stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the mix; a document that is taken k times appears k times.

    Null is a source, the last one; null and empty texts have no words; a null doc_id goes by its text. Of repeated rows
    and rows of one id some may be taken more often than others. Columns of any name stay. An empty table stays empty.
    """
    return mixing.mix(docs, weights=(5, 2, 1), cap=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256`` of each row.

    Null and empty texts have no ids; long ones are encoded whole. Repeated rows and nulls stay; other columns go. An
    empty table gives an empty one.
    """
    return bpe.encoded_with_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifiers nor the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage wrote for itself, and
    the result of the stage before, are removed then."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, since, keep=docs)
    return docs
