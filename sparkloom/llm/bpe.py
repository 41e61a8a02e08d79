"""BPE encoding and decoding of whole texts by a table of distinct words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, carried, own, restored, text_bytes
from sparkloom.llm.word_table import distinct_words, frequent, text_groups, word_tokenizer


class _Ids:
    """Ids of words as bytes: the broadcast table's, and those of rarer words once encoded in this task."""

    #: Rarer words held at once.
    ROOM = 400_000

    def __init__(self, path: str, table: dict[str, bytes]) -> None:
        self._encode, self._table, self._rare = word_tokenizer(path).encode, table, {}

    def of(self, words: list[list[str]]) -> list[bytes]:
        """Ids of each text's words, joined by position."""
        known, rare = self._table, self._rare
        absent = [w for w in set().union(*words).difference(known) if w not in rare]
        if len(rare) + len(absent) > self.ROOM:
            rare.clear()
            absent = list(set().union(*words).difference(known))
        rare.update(zip(absent, (np.array(x, dtype="<u4").tobytes() for x in self._encode(absent)), strict=True))
        return [b"".join([known.get(w) or rare[w] for w in text]) for text in words]


def _table(words: DataFrame, special: dict[str, int]) -> dict[str, bytes]:
    rows = frequent(words)[0].select("word", "ids").toArrow()
    ids = dict(zip(rows.column("word").to_pylist(), (np.array(x, dtype="<u4").tobytes() for x in rows.column("ids").to_pylist()), strict=True))
    return ids | {text: np.array([i], dtype="<u4").tobytes() for text, i in special.items()}


def _batches(path: str, table, make: Callable[[bytes], tuple], kinds: list[pa.DataType]) -> Callable:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = word_tokenizer(path).words, _Ids(path, table.value)
        for batch in batches:
            made = [make(x) for group in text_groups(batch) for x in ids.of([split(text) for text in group])]
            columns = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            arrays = [batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *(f"c{k}" for k in range(len(kinds)))])

    return encoded


def _mapped(docs: DataFrame, path: str, keep: list[str], make: Callable[[bytes], tuple], columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Columns ``keep`` of each row and what ``make`` gives for the row's ids, named and typed by ``columns``.

    The frequent words' ids are joined by a broadcast table of a fixed bound; a rarer word is encoded where it occurs,
    once in a task.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_table(distinct_words(docs, path), word_tokenizer(path).special))
    bounded_batches(spark)
    rows = docs.select(carried(docs, keep).alias("row"), text_bytes(docs["text"]).alias("_text"))
    kinds = ", ".join(f"c{k} {kind}" for k, (kind, _) in enumerate(columns.values()))
    made = rows.mapInArrow(_batches(path, table, make, [k for _, k in columns.values()]), f"row {rows.schema['row'].dataType.simpleString()}, {kinds}")
    return made.select(*restored("row", keep), *(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the columns of ``docs`` but for ids) and ``ids``, the token ids of every whole text, as an array.

    The ids are those of the tokenizers library without added special tokens, truncation or padding; special tokens'
    strings in a text become their ids. Null texts have no ids. Repeated rows stay; an empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c != "ids"] if keep is None else keep
    return _mapped(docs, path, keep, lambda ids: (np.frombuffer(ids, "<u4").astype(np.int32),), {"ids": ("array<int>", pa.list_(pa.int32()))})


def decoder(path: str) -> Callable[[np.ndarray], str]:
    """The library's decode(ids, skip_special_tokens=False) by a join to the id-to-piece table: pieces, spaces between."""
    piece = word_tokenizer(path).pieces().__getitem__
    return lambda ids: " ".join(map(piece, ids.tolist()))


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids in ``column``; no ids (null or empty) give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(path)
        for batch in batches:
            made = [text(np.asarray(x or (), dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.string())], names=["row", "decoded"])

    keep = [c for c in rows.columns if c != "decoded"]
    held = rows.select(carried(rows, keep).alias("row"), own(rows, column).cast("array<int>").alias("ids"))
    made = held.mapInArrow(decoded, f"row {held.schema['row'].dataType.simpleString()}, decoded string")
    return made.select(*restored("row", keep), "decoded")


_DIGESTS = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _digest(path: str) -> Callable[[bytes], tuple[int, str, str]]:
    def made(ids: bytes, cache: dict = {}) -> tuple[int, str, str]:  # noqa: B006  one decoder in each Python worker
        if path not in cache:
            cache[path] = decoder(path)
        text = cache[path](np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return made


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, encoded and decoded again.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. Null and empty
    texts have no ids and the digests of nothing; texts of any length are encoded whole, equal ones alike. Repeated rows
    and null doc_ids stay. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    return _mapped(docs, path, ["doc_id"], _digest(path), _DIGESTS)


def encoded_with_digests(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep``, columns of ``docs``, then those of :func:`digests` and ``ids``; of ``keep`` none may have such a name.

    Nulls, empty and long texts, repeated rows and empty tables are as there; ``docs`` may have other columns of any name.
    """
    digest = _digest(path)
    return _mapped(docs, path, keep, lambda ids: (*digest(ids), np.frombuffer(ids, "<i4")), _DIGESTS | {"ids": ("array<int>", pa.list_(pa.int32()))})
