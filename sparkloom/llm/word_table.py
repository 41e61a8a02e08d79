"""The table of distinct words behind BPE encoding and token counts.

A tokenizer file of kind BPE with word ends lower-cases a text, drops its white space and encodes each word by itself. So
a text's ids follow from its words, and Spark needs to encode each distinct word once only.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from sparkloom.llm.common import bounded_batches, text_bytes, written

#: The split pattern, the normaliser and the pre-tokenizer of such tokenizer files.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Texts of characters up to here, Latin letters and the punctuation below, are split by the pattern in Python; the
#: library splits all others, so the two can't differ on rarer characters.
PLAIN = regex.compile("[\\x21-\\x7e \t\n\r\\xa1-\\xac\\xae-\\u012f\\u0132-\\u0148\\u014a-\\u017e‐-‧]*")
#: A task's count of words is handed on once it holds so many distinct ones.
HELD_WORDS = 500_000
#: So many most frequent words, the bound of what is broadcast.
FREQUENT_WORDS = 1 << 18


class WordTokenizer:
    """Splits texts into a tokenizer file's words and encodes words.

    Words stand for themselves only if the file normalises and splits as is known here, and special tokens are taken from
    the raw text; a file that does otherwise is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        plain = [t["content"] for t in kind["added_tokens"] if not any(t[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized"))]
        known = kind["model"]["type"] == "BPE" and not kind["model"]["dropout"] and len(plain) == len(kind["added_tokens"]) and all(plain)
        if not known or kind["normalizer"] != NORMALIZER or kind["pre_tokenizer"] != PRE_TOKENIZER or kind["decoder"]:
            raise ValueError(f"{path} does not encode each word by itself in the way that is known here")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self._split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self._normal = self.tokenizer.normalizer.normalize_str
        self._word = regex.compile(WORD).findall
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: i for i, token in added.items()}
        self._start = os.path.commonprefix([*self.special])  # of all special tokens; a text without it has none
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else None

    def words(self, text: str) -> list[str]:
        """Words in order; a special token's string is a word of its own."""
        if self._special and self._start in text:
            parts = self._special(text)
            if len(parts) > 1:
                return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._plain_words(part))]
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self._word(text.lower())
        return [word for word, _ in self._split(self._normal(text))] if text else []

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_word(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def pieces(self) -> list[str]:
        """The id-to-piece table, a fixed few ten thousand entries."""
        return [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def texts(batch: pa.RecordBatch, name: str = "_text") -> Iterator[str]:
    return (t.decode("utf-8", "replace") for t in batch.column(name).to_pylist())


def text_groups(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[list[str]]:
    """The batch's texts in turn, in groups of about ``size`` characters, a longer text by itself."""
    held, n = [], 0
    for text in texts(batch):
        held.append(text)
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _counter(path: str) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_tokenizer(path).words
        counts: Counter = Counter()
        for batch in batches:
            for text in texts(batch):
                counts.update(split(text))
                if len(counts) >= HELD_WORDS:
                    yield from _rows(counts)
                    counts = Counter()
        yield from _rows(counts)

    return counted


def _rows(counts: Counter, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    words, n = list(counts), list(counts.values())
    for at in range(0, len(words), size):
        yield pa.RecordBatch.from_arrays([pa.array(words[at : at + size], pa.string()), pa.array(n[at : at + size], pa.int64())], names=["word", "n"])


def _encoder(path: str, ids: bool) -> Callable:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).encode
        for batch in batches:
            found = encode(batch.column("word").to_pylist())
            made = pa.array(found, pa.list_(pa.int32())) if ids else pa.array(map(len, found), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), made], names=["word", "n", "made"])

    return encoded


def _distinct(docs: DataFrame, path: str, ids: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    counts = docs.select(text_bytes(docs["text"]).alias("_text")).mapInArrow(_counter(path), "word string, n long")
    words = counts.groupBy("word").agg(F.sum("n").alias("n"))
    words = words.mapInArrow(_encoder(path, ids), f"word string, n long, made {'array<int>' if ids else 'int'}")
    return written(words.withColumnRenamed("made", "ids" if ids else "pieces"), "words")


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """``word, n, ids``: each distinct word of all texts once, its occurrences and its ids; written to the shared folder."""
    return _distinct(docs, path, ids=True)


def distinct_word_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``word, n, pieces``: as :func:`distinct_words`, with the number of ids only."""
    return _distinct(docs, path, ids=False)


def frequent(words: DataFrame, size: int = FREQUENT_WORDS) -> tuple[DataFrame, int]:
    """The most frequent words, ``size`` at most whatever the corpus, and the least occurrences that they have.

    Words are counted by classes of their occurrences, sixteen to each doubling, and whole classes are taken from the top
    while they fit; so no task sorts all words.
    """
    log = F.floor(F.log2("n") * 16)
    classes = words.groupBy(log.alias("class")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.col("class").desc()).collect()
    fits, least = 0, 1 << 62
    for row in classes:
        fits += row["words"]
        if fits > size:
            break
        least = row["n"]
    return words.where(F.col("n") >= least), least
