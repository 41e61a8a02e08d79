"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is cut into words and runs of symbols. Its n-grams are each token, each pair of neighbours, and each pair of their
shapes (case, digits, symbols, and whether the second repeats the first), hashed into a fixed number of buckets. The
score is the logistic of a sparse dot product: for each bucket its share of the tokens times its weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, carried, restored, text_bytes

#: Buckets of n-grams; one more weight is the bias.
BUCKETS = 1 << 18
#: At most about so many labelled documents train the model, taken by a hash of their ids.
TRAIN_ROWS = 8192
#: A text's shares are scaled by this, so that steps on shares and on the bias are alike.
SCALE = 8.0
#: Of follow-the-regularised-leader (McMahan et al., KDD 2013), and how often it passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.02, 4
#: Texts are hashed so many bytes at a time, longer ones in windows of this size; no result depends on it.
WINDOW = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    both = []
    for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        steps = np.full(WINDOW + 1, b, dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def _classes() -> np.ndarray:
    """0 blank, 1 letter or digit (any byte beyond ASCII too), 2 symbol."""
    kind = np.full(256, 2, dtype=np.int8)
    kind[[*range(9, 14), 32]] = 0
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kind


_KIND = _classes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and bytes of texts in groups of a window at most; a longer text is a group by itself."""
    at, held, n = [], [], 0
    for k, text in enumerate(texts):
        if n + len(text) + 1 > WINDOW and held:
            yield at, held
            at, held, n = [], [], 0
        at.append(k)
        held.append(text)
        n += len(text) + 1
    if held:
        yield at, held


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bytes in windows that end where a token or a run of blanks does; one that is longer is a window by itself."""
    at = 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            kind = _KIND[data[at : end + 1]]
            changes = np.flatnonzero(kind[1:] != kind[:-1])
            if len(changes):
                end = at + int(changes[-1]) + 1
            else:
                while end < len(data) and (same := _KIND[data[end : end + WINDOW]] == kind[0]).all():
                    end += len(same)
                if end < len(data):
                    end += int(same.argmin())
        yield data[at:end]
        at = end


def _shape(kind: np.ndarray, n: np.ndarray, capitals: np.ndarray, digits: np.ndarray, first_upper: np.ndarray) -> np.ndarray:
    """Case, digits or length of tokens, as a number: small 0, first capital 1, all capitals 2, else 3, digits 4, signs 6 to 9."""
    shape = np.select([kind == 2, digits > 0, capitals == 0, (capitals == n) & (n > 1), first_upper & (capitals == 1)], [5, 4, 0, 2, 1], 3)
    return np.where(shape == 5, 5 + np.minimum(n, 4), shape)


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash, shape and kind of each token of a window."""
    if len(data) > WINDOW:  # one token or a run of blanks, by pieces
        if not _KIND[data[0]]:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int8))
        h, capitals, digits = 0, 0, 0
        for at in range(0, len(data), WINDOW):
            some = data[at : at + WINDOW]
            h += int(_sums(some)[-1]) * pow(int(_BASE), at, 1 << 64)
            capitals += int(((some >= 65) & (some <= 90)).sum())
            digits += int(((some >= 48) & (some <= 57)).sum())
        kind = _KIND[data[:1]]
        shape = _shape(kind, *(np.array([x]) for x in (len(data), capitals, digits, 65 <= data[0] <= 90)))
        return np.zeros(1, dtype=np.int64), _mixed(np.array([h % (1 << 64)], dtype=np.uint64)), shape, kind
    kind = _KIND[data]
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(data)]))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    sums, upper = _sums(data), (data >= 65) & (data <= 90)
    uppers = np.concatenate(([0], np.cumsum(upper)))
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    token = _mixed((sums[ends] - sums[starts]) * _powers()[1][starts])
    return starts, token, _shape(kind[starts], ends - starts, uppers[ends] - uppers[starts], digits[ends] - digits[starts], upper[starts]), kind[starts]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes in small letters times powers of the base; a token's hash is a difference of two."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    return np.concatenate(([np.uint64(0)], np.cumsum((lower + np.uint64(1)) * _powers()[0][: len(data)], dtype=np.uint64)))


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts or windows of long ones: the text's number and the bucket of each n-gram, and the text's number
    of each token.

    Windows do not show in the result: none cuts a token, and each goes on from the last token and the last word before.
    """
    for at, held in _groups(texts):
        data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1)
        number, done = np.asarray(at), 0
        before = [np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int8)]  # text, hash, shape and kind
        for window in _windows(data):
            starts, *own = _tokens(window)
            text = np.searchsorted(ends, starts + done, side="right")
            done += len(window)
            if not len(starts):
                continue
            known = len(before[0])
            text, token, shape, kind = (np.concatenate(x) for x in zip(before, (text, *own), strict=True))
            joined = text[1:] == text[:-1]
            joined[: max(0, known - 1)] = False  # counted before
            pair = _mixed(token[:-1] * np.uint64(3) + token[1:])[joined]
            # a symbol between two equal words does not hide that they repeat
            words = np.flatnonzero(kind == 1)
            again = np.zeros(len(token), dtype=np.int64)
            if len(words) > 1:
                again[words[1:]] = (token[words[1:]] == token[words[:-1]]) & (text[words[1:]] == text[words[:-1]])
            shapes = _mixed((shape[:-1] * 32 + shape[1:] * 2 + again[1:] + 1_000_003).astype(np.uint64))[joined]
            owner = np.concatenate((text[known:], text[1:][joined], text[1:][joined]))
            bucket = np.concatenate((token[known:], pair, shapes)) % np.uint64(BUCKETS)
            yield number[owner], bucket.astype(np.int64), number[text[known:]]
            last = sorted({*words[-1:].tolist(), len(token) - 1})
            before = [x[last] for x in (text, token, shape, kind)]


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's buckets, how often it has each, and its number of tokens."""
    counts, used, tokens = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for _, bucket, token in ngrams([text]):
        tokens += len(token)
        if len(text) < WINDOW:  # all at once
            used, counts = np.unique(bucket, return_counts=True)
        else:
            counts = np.bincount(bucket, minlength=BUCKETS) + (counts if len(counts) else 0)
    if len(text) >= WINDOW:
        used = np.flatnonzero(counts)
        counts = counts[used]
    return used, counts, tokens


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text as its buckets and their values."""
    for batch in batches:
        for k, text in enumerate(batch.column("_text").to_pylist()):
            bucket, counts, tokens = _counted(text)
            row = [batch.column("order").slice(k, 1), batch.column("label").slice(k, 1), pa.array([bucket.tolist()], pa.list_(pa.int32())), pa.array([(counts * (SCALE / max(1, tokens))).tolist()], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(row, names=["order", "label", "bucket", "value"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of the buckets and, last, the bias, from (label, buckets, values) of each text, in this order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for y, buckets, values in rows:
            i, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(BUCKETS + 1))


def _trained(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in rows:  # as arrays: lists of numbers would take ten times the room
        ends = batch.column("bucket").offsets.to_numpy()
        buckets, values = (batch.column(k).values.to_numpy() for k in ("bucket", "value"))
        for k, (order, label) in enumerate(zip(batch.column("order").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            some = slice(ends[k], ends[k + 1])
            held.append((order, label, buckets[some].copy(), values[some].copy()))
    held.sort(key=lambda r: r[0])
    weights = ftrl([r[1:] for r in held])
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(weights[used])], names=["bucket", "weight"])


def labelled_ids(labels: DataFrame, label: str, fold: int, left_out: int, bound: int) -> DataFrame:
    """``_id, order, label``: at most about ``bound`` labelled ids outside a fold, by a hash of the id.

    An id with several labels counts as 1 if any is 1; null ids and null labels are ignored.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(in_fold(F.col("_id"), fold) != left_out).groupBy("_id").agg(F.max("label").cast("int").alias("label"))
    rows = rows.withColumn("order", F.xxhash64(F.col("_id").cast("string")))
    total = rows.count()
    share = min(1.0, bound / max(1, total))
    return rows.where(F.shiftrightunsigned("order", 33) < int(share * (1 << 31)))


def in_fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, left_out: int = 0, bound: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled documents outside fold ``left_out`` of ``folds`` (by crc32 of the id as text).

    The sample is bounded, so its ids are broadcast and one task learns from them in turn. Without any labelled row all
    weights are 0, and every text scores 0.5.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = labelled_ids(labels, label, folds, left_out, bound)
    sample = docs.select(docs["doc_id"].alias("_doc"), text_bytes(docs["text"]).alias("_text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    sparse = sample.select("_text", "order", "label").mapInArrow(_sparse, "order long, label int, bucket array<int>, value array<float>")
    model = sparse.repartition(1).mapInArrow(_trained, "bucket int, weight double").toArrow()
    weights = np.zeros(BUCKETS + 1, dtype=np.float32)
    weights[model.column("bucket").to_numpy()] = model.column("weight").to_numpy()
    return weights


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    total, tokens = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, bucket, token in ngrams(texts):
        total += np.bincount(owner, weights[bucket], minlength=len(texts))
        tokens += np.bincount(token, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(weights[-1] + SCALE * total / np.maximum(tokens, 1), -35, 35)))


def _scorer(weights) -> Callable:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(batch.column("_text").to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found)], names=["_row", "_score"])

    return scored


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``_row``, the carried columns ``keep``, and ``_score`` of every whole text; null texts score as empty ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(carried(docs, keep).alias("_row"), text_bytes(docs["text"]).alias("_text"))
    model = spark.sparkContext.broadcast(weights)
    return rows.mapInArrow(_scorer(model), f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, left_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Empty and null texts score by the bias alone, and equal texts alike. Long texts are read in windows, in memory that
    grows only with the text itself, and score as if they were read at once. Repeated rows stay; an empty table gives an
    empty table; a null doc_id is not held out. Other columns of ``docs`` are not read.
    """
    found = scored(docs, train(docs, labels, "quality", folds, left_out), ["doc_id"])
    held_out = F.coalesce(in_fold(F.col("_row.c0"), folds) == left_out, F.lit(False))
    return found.select(*restored("_row", ["doc_id"]), held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they are, whatever their names.

    Null, empty and long texts score as :func:`quality_scores` says; equal texts stay or go together, repeated rows stay
    repeated, and a null doc_id makes no difference. Where no label is known every text scores 0.5. An empty table gives
    an empty table.
    """
    found = scored(docs, train(docs, labels), docs.columns)
    return found.where(F.col("_score") >= threshold).select(*restored("_row", docs.columns))
