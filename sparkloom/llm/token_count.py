"""Token counts of whole texts from word frequencies, without their ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, text_bytes
from sparkloom.llm.word_table import FREQUENT_WORDS, distinct_word_pieces, frequent, texts, word_tokenizer

#: A document without rare words meets none of them under one of so many words that no text has.
EMPTY_KEYS = 4096


def _frequencies(path: str, table) -> Callable:
    """For each document its tokens in frequent words, and a row for each of its distinct rarer words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = word_tokenizer(path).words, table.value
        for batch in batches:
            at, base, words, n = [], [], [], []
            for k, text in enumerate(texts(batch)):
                total, rare = 0, []
                for word, times in Counter(split(text)).items():
                    known = pieces.get(word)
                    if known is None:
                        rare.append((word, times))
                    else:
                        total += known * times
                rare = rare or [(f"\x00 {k % EMPTY_KEYS}", 0)]
                at += [k] * len(rare)
                base += [total] + [0] * (len(rare) - 1)
                words += [w for w, _ in rare]
                n += [t for _, t in rare]
            rows = batch.column("_row").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(base, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["_row", "_base", "_word", "_times"])

    return counted


def token_counts(docs: DataFrame, path: str, limit: int = 2048, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document, null texts as empty.

    Each distinct word's pieces are counted once. The ``frequent_words`` most frequent words, a bounded table, are
    broadcast and joined within the task; a document's other words, each with its frequency, join the table of all words
    by a shuffle, in which no word can be hot. Texts of any length are counted whole. Repeated rows and null doc_ids each
    count; an empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    words = distinct_word_pieces(docs, path)
    top, least = frequent(words, frequent_words)
    top = top.select("word", "pieces").toArrow()
    table = dict(zip(top.column("word").to_pylist(), top.column("pieces").to_pylist(), strict=True))
    table |= dict.fromkeys(word_tokenizer(path).special, 1)
    bounded_batches(spark)
    text = text_bytes(docs["text"])
    row = F.struct(F.monotonically_increasing_id().alias("at"), docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = docs.select(row.alias("_row"), text.alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    counts = rows.mapInArrow(_frequencies(path, spark.sparkContext.broadcast(table)), f"_row {kind}, _base long, _word string, _times long")
    rare = words.where(F.col("n") < least).select("word", "pieces")
    joined = counts.join(rare, F.col("_word") == F.col("word"), "left")
    total = F.sum(F.col("_base") + F.col("_times") * F.coalesce("pieces", F.lit(0)))
    found = joined.groupBy("_row.at", "_row.doc_id", "_row.n_bytes").agg(total.alias("n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
