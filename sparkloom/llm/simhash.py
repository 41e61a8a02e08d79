"""SimHash near-duplicates: fingerprints of word shingles, linked through Gray-ordered hierarchical indexes.

Two fingerprints that differ in at most 3 of 64 bits agree on at least one of four 16-bit blocks, so every fingerprint is
dealt to four buckets, one for each block and its value. Within a bucket the fingerprints are sorted by Gray rank, runs
of them become the leaves of a tree whose upper nodes hold the bits that all below share, and a search drops a whole
node once the differences in the shared bits exceed the limit (Tang et al., EDBT 2015).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, text_bytes, whole_groups, written
from sparkloom.llm.components import connected_components, local_roots

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Children of a node of the index, and pairs of fingerprint and node that are looked at together.
FAN, FRONTIER = 8, 2_000_000
#: A bucket of more fingerprints is dealt again by four blocks of its free bits; LEVELS are the widths of such blocks.
BUCKET, LEVELS = 4096, (16, 12, 9)


def fingerprint(text: bytes) -> int:
    """64 bits; a bit is 1 if it is 1 in over half of the shingles' hashes. No words: 0; fewer than three: one shingle."""
    words = text.lower().split()  # of bytes: exactly A-Z, and exactly the blanks \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t) for t in batch.column("_text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every document, the fingerprint as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes("text").alias("_text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _blocks(free: int, width: int) -> list[int]:
    """Four masks of ``width`` of the ``free`` bits, low to high; together they hold every free bit."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[k * width : (k + 1) * width]) for k in range(4)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, path_masks: list[tuple[int, int]], width: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Each row once for each of four further blocks. ``path_masks``: the number and fixed bits of each kind of bucket."""
    kinds, options = [], []
    for code, fixed in path_masks:
        full = (1 << 64) - 1
        made = [(code * 5 + k + 1, fixed | block) for k, block in enumerate(_blocks(full & ~fixed, width))]
        kinds += made
        each = F.array(*(F.struct(F.lit(c).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for c, m in made))
        options.append(F.when(F.col("kind") == code, each))
    return rows.withColumn("_b", F.explode(F.coalesce(*options))).select("fp", "_b.kind", "_b.bits"), kinds


def buckets(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``fp, kind, bits, part`` so that any two fingerprints within 3 bits meet in some (kind, bits, part).

    A bucket over ``limit`` is dealt again by blocks of its free bits, twice at most; what is still over it, a dense
    cloud of near copies, is parted by hash and every two parts meet.
    """
    rows, kinds = distinct.select("fp", F.lit(0).alias("kind")), [(0, 0)]
    done = None
    for width in LEVELS:
        rows, kinds = _dealt(rows, kinds, width)
        rows = written(rows, "simhash-buckets")
        large = rows.groupBy("kind", "bits").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        large = written(large.select(F.col("kind").alias("_kind"), F.col("bits").alias("_bits"), "_n"), "simhash-large")
        same = (F.col("kind") == F.col("_kind")) & (F.col("bits") == F.col("_bits"))
        if large.isEmpty():
            small, rows = rows, None
        else:
            small, rows = rows.join(large, same, "left_anti"), rows.join(large, same)
        small = small.select("fp", "kind", "bits", F.lit(0).cast("long").alias("part"))
        done = small if done is None else done.union(small)
        if rows is None:
            return done
    parts = F.ceil(F.col("_n") / limit)
    own = F.pmod(F.xxhash64("fp"), parts)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.least(k, own) * parts + F.greatest(k, own))
    return done.union(rows.select("fp", "kind", "bits", F.explode(meet).alias("part")))


def _nodes(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of the index, leaves first: (first child, end of children, own shared bits, their pattern); one root for
    each bucket [start, end)."""
    levels = []
    ones, zeros = fp, fp  # AND and OR of all fingerprints below
    while True:
        sizes = ends - starts
        groups = (sizes + FAN - 1) // FAN
        bucket = np.repeat(np.arange(len(starts)), groups)
        first_group = np.cumsum(groups) - groups
        first = starts[bucket] + (np.arange(len(bucket)) - first_group[bucket]) * FAN
        end = np.minimum(first + FAN, ends[bucket])
        ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(zeros, first)
        levels.append([first, end, ~(ones ^ zeros), ones])
        if (groups <= 1).all():
            break
        starts, ends = first_group, first_group + groups
    for (_, _, mask, _), (first, end, above, _) in zip(levels, levels[1:], strict=False):
        mask &= ~np.repeat(above, end - first)  # bits that a parent shares count there
    return [tuple(x) for x in levels]


def pairs_within(fp: np.ndarray, bucket: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of equal ``bucket`` that differ in ``max_bits`` at most. The arrays are sorted by bucket, then by
    Gray rank."""
    changes = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    starts, ends = np.concatenate(([0], changes)), np.concatenate((changes, [len(fp)]))
    own = np.repeat(np.arange(len(starts)), ends - starts)
    levels = _nodes(fp, starts, ends)
    return _descend(fp, np.arange(len(fp)), own, np.zeros(len(fp), dtype=np.uint8), levels, len(levels) - 1, max_bits)


def search(fp: np.ndarray, bucket: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges among fingerprints of equal ``bucket`` that differ in ``max_bits`` at most: each linked one and the first of
    those it is linked to over any number of steps. The arrays are sorted by bucket, then by Gray rank."""
    pairs = list(pairs_within(fp, bucket, max_bits))
    if not pairs:
        return fp[:0], fp[:0]
    root = local_roots(*(np.concatenate(x) for x in zip(*pairs, strict=True)), len(fp))
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def _descend(fp, query, node, differ, levels, depth, max_bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows, from pairs of a query and a node of ``depth`` with the differences in the bits above that node."""
    first, end, mask, pattern = levels[depth]
    differ = differ + np.bitwise_count((fp[query] ^ pattern[node]) & mask[node])
    keep = differ <= max_bits
    query, node, differ = query[keep], node[keep], differ[keep]
    below = end[node] - first[node]
    share = np.cumsum(below) // FRONTIER  # so many children at once
    for k in range(int(share[-1]) + 1 if len(share) else 0):
        some = share == k
        n = below[some]
        child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node[some]], n)
        asks = np.repeat(query[some], n)
        if depth:
            yield from _descend(fp, asks, child, np.repeat(differ[some], n), levels, depth - 1, max_bits)
        else:
            ahead = asks < child
            asks, child = asks[ahead], child[ahead]
            near = np.bitwise_count(fp[asks] ^ fp[child]) <= max_bits
            if near.any():
                yield asks[near], child[near]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["kind", "bits", "part"]):
        kind, bits, part = (rows.column(k).to_numpy() for k in ("kind", "bits", "part"))
        new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (bits[1:] != bits[:-1]) | (part[1:] != part[:-1])))
        bucket = np.cumsum(new)
        several = np.bincount(bucket)[bucket] > 1
        if several.any():
            fp = rows.column("fp").to_numpy()[several].view(np.uint64)
            a, b = search(fp, bucket[several])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def gray_rank(fp):
    """Place of a bit pattern in the Gray sequence: each bit is the parity of the pattern's bits from there up."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def gray(fp: np.ndarray) -> np.ndarray:
    """:func:`gray_rank` of an array."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return fp


def link_edges(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``a, b``: edges whose components are those of all links among the ``fp`` of ``distinct``."""
    dealt = buckets(distinct, limit).repartition("kind", "bits", "part")
    dealt = dealt.withColumn("_gray", gray_rank(F.col("fp"))).sortWithinPartitions("kind", "bits", "part", "_gray")
    return dealt.drop("_gray").mapInArrow(_bucket_edges, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like others; texts of any length are read whole.
    Repeated rows stay repeated, and so do ties: equal fingerprints are one node of the search. The component is the smallest doc_id reachable over links; a null doc_id never is the smallest unless there is no other.
    An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    rows = written(fingerprints(docs), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-distinct")
    reached = connected_components(link_edges(distinct, limit))
    own = distinct.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("component", "fp").alias("_component"))
    own = written(own, "simhash-components")
    least = own.groupBy(F.col("_component").alias("_c")).agg(F.min("_least").alias("component_id"))
    ids = written(own.join(least, F.col("_component") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id"), "simhash-ids")
    found = rows.join(ids, F.col("fp") == F.col("_fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: one document of each group of near copies, see :func:`near_copies.keep_one`. It is by five-word
    shingles and a similarity of 0.8, so not by op8's single fingerprint."""
    from sparkloom.llm import near_copies  # which searches by this module

    return near_copies.keep_one(docs)
