"""Near copies of any wording: documents whose sets of word shingles have a Jaccard similarity of at least a limit.

SimHash proposes pairs, each of which is verified on its texts. At a similarity of 0.8 two fingerprints of 64 bits differ
in about ten bits, so one of them cannot tell such pairs from others. A text therefore has 32 fingerprints, each dealt by
its four blocks of 16 bits, as op8's one is; a bucket's documents are searched through op8's Gray-ordered index by the first
fingerprint, and the second narrows what it finds. At 0.8 two documents share no block with a probability of 1 in 13,000,
less above; what is linked is exact. Each document's few foremost proposals are verified as pairs. Documents that proposals
lead to over any steps are a family; where it is not one component then, all its documents of different components are
compared by their shingle sets within tasks, which hand out links only, never the pairs that they compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, carried, restored, text_bytes, whole_groups, written
from sparkloom.llm.components import connected_components, local_roots
from sparkloom.llm.simhash import gray, pairs_within

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Fingerprints of 64 bits, and blocks of each.
WORDS, BLOCKS = 32, 4
#: Bits in which the first fingerprint, the first two and all may differ. At 0.8 these are 10, 19 and 310 in the mean, with
#: deviations of 3, 4 and 16. Where fewer than NEAR of two differ, the smaller row is preferred.
FIRST_BITS, TWO_BITS, ALL_BITS, NEAR = 24, 38, 430, 20
#: Proposals of a document that are verified as pairs; its family settles the others.
FOREMOST = 4
#: Documents of one bucket, or documents and shingles of one family, that meet in a task; more are cut into parts of which
#: every two meet. Shingles counted at once.
BUCKET, BLOCK, SHINGLES, COLUMNS = 8192, 4096, 1 << 19, 4096
KEY = ["band", "part"]

_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``shingle`` are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash in WORDS numbers: a bit is 1 if it is 1 in over half of the shingles' hashes, mixed anew for each number."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many bits are counted in a byte
        x = hashes[at : at + 255, None] ^ _SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each block of the fingerprints; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    return fingerprints(hashes).view(np.uint16) + (np.arange(WORDS * BLOCKS) << 16)


def _keys(words: str) -> Column:
    """The keys of :func:`bands` of a column of fingerprints."""
    return F.flatten(F.transform(words, lambda w, k: F.array(*(F.shiftrightunsigned(w, 16 * j).bitwiseAND(65535) + (k * BLOCKS + j) * 65536 for j in range(BLOCKS)))))


def _signed(shingle: int) -> Callable:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            words = pa.array([fingerprints(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), digests, pa.array([len(s) for s in sets], pa.int64()), words], names=["row", "digest", "size", "words"])

    return signed


def _proposed(similarity: float) -> Callable:
    """``root, a, b``: for each document of a bucket that has near ones the one to verify it with first, and ``root``, the
    smallest that near ones lead to over any steps."""

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, KEY):
            band, part, node, size, fp, second = (rows.column(c).to_numpy() for c in [*KEY, "node", "size", "first", "second"])
            order = np.lexsort((gray(fp.view(np.uint64)), part, band))
            band, part, node, size, fp, second = (x[order] for x in (band, part, node, size, fp, second))
            fp, second = fp.view(np.uint64), second.view(np.uint64)
            change = np.concatenate(([True], (band[1:] != band[:-1]) | (part[1:] != part[:-1])))
            bucket = np.cumsum(change)
            several = np.bincount(bucket)[bucket] > 1
            if not several.any():
                continue
            band, part, node, size, fp, second, bucket = (x[several] for x in (band, part, node, size, fp, second, bucket))
            place = np.argsort(np.argsort(node, kind="stable"), kind="stable")  # of the smaller row
            by_place = np.argsort(place)
            root, best = np.arange(len(fp)), np.full(len(fp), np.iinfo(np.int64).max)
            for a, b in pairs_within(fp, bucket, FIRST_BITS):
                differ = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) + np.bitwise_count(second[a] ^ second[b])
                near = (differ <= TWO_BITS) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) * (1 - 1e-12)) & (node[a] != node[b])
                a, b, differ = a[near], b[near], np.maximum(differ[near], NEAR) << 40
                np.minimum.at(best, a, differ | place[b])
                np.minimum.at(best, b, differ | place[a])
                root = local_roots(np.concatenate((place[a], np.arange(len(fp)))), np.concatenate((place[b], root)), len(fp))
            have = np.flatnonzero(best < np.iinfo(np.int64).max)
            to = by_place[best[have] & ((1 << 40) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[by_place[root[place[have]]]], node[have], node[to])], names=["root", "a", "b"])

    return proposed


def _with_sets(shingle: int) -> Callable:
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            names = ["family", "parts", "node", "component"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sets], names=[*names, "shingles"])

    return with_sets


def joining_pairs(sets: list[np.ndarray], component: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``sets``, none empty, that reach the similarity: so few that they join all components that any such pair does.

    Sets are held by their differences from the shingles that most of them have. Two sets differ in as many shingles as
    their differences do, so near copies are counted by the few shingles that set them apart.
    """
    size, n = np.array([len(x) for x in sets]), len(sets)
    shingle, times = np.unique(np.concatenate(sets), return_counts=True)
    usual = shingle[times * 2 > n]
    sets = [np.setxor1d(x, usual, assume_unique=True) for x in sets]
    far = np.array([len(x) for x in sets])
    _, held, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), far)[np.argsort(held, kind="stable")]  # of each shingle, from ``first`` on
    first, start = np.cumsum(times) - times, np.cumsum(far) - far
    own = np.unique(component, return_inverse=True)[1]
    pairs = []
    for k in np.flatnonzero(own != np.bincount(own).argmax()):
        some = held[start[k] : start[k] + far[k]]
        many = times[some]
        at = np.arange(many.sum()) + np.repeat(first[some] - np.cumsum(many) + many, many)
        shared = np.bincount(holders[at], minlength=n)
        both = (size + size[k] - far - far[k]) // 2 + shared  # the first is even: sizes and differences have one parity
        near = np.flatnonzero((own != own[k]) & (both / (size + size[k] - both) >= similarity))
        joined, other = np.unique(own[near], return_index=True)
        pairs += [(k, near[x]) for x in other]
        if len(joined):
            own[np.isin(own, joined)] = own[k]
    return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)


def _joined(similarity: float) -> Callable:
    """``a, b``: links between the components of the documents of a family that meet."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["family", "meet"]
        for rows in whole_groups(batches, keys, 1):
            marks = [rows.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in marks], axis=0)) + 1
            node, component, shingles = (rows.column(c) for c in ("node", "component", "shingles"))
            node, component = node.to_numpy(), component.to_numpy()
            for at, end in zip([0, *change], [*change, rows.num_rows], strict=True):
                if (component[at:end] != component[at]).any():
                    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in shingles[at:end]]
                    a, b = joining_pairs(sets, component[at:end], similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(node[at + a]), pa.array(node[at + b])], names=["a", "b"])

    return joined


def _compared(shingle: int, similarity: float) -> Callable:
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # pairs come sorted by one end, so a hub is hashed once

        def known_set(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingle_set(text.as_py(), shingle)
            return known[node]

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ends = zip(a.to_pylist(), b.to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)
            near = [jaccard(known_set(x, s), known_set(y, t)) >= similarity for x, y, s, t in ends]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return compared


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b, near`` for each of the pairs."""
    ends = [texts.select(F.col("row").alias(f"_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab"]
    met = pairs.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b"))
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_compared(shingle, similarity), "a long, b long, near boolean")


def near_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``sets`` that reach the similarity, by counting the shingles that each two share."""
    size = np.array([len(x) for x in sets])
    shingle, times = np.unique(np.concatenate(sets), return_counts=True)
    shingle = shingle[times > 1]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, len(shingle), COLUMNS):
        some = shingle[at : at + COLUMNS]
        holds = np.zeros((len(sets), len(some)), dtype=np.float32)
        for row, x in zip(holds, sets, strict=True):
            x = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
            if len(x):
                place = np.searchsorted(some, x)
                row[place[some[place] == x]] = 1
        both += holds @ holds.T
    a, b = np.nonzero(np.triu(both, 1))
    near = both[a, b] / (size[a] + size[b] - both[a, b]) >= similarity
    return a[near], b[near]


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those of the pairs, each once, whose fingerprints differ in ALL_BITS at most."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = [signed.select(F.col("node").alias(f"_{c}"), F.col("words").alias(f"words_{c}")) for c in "ab"]
    met = pairs.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b"))
    bits = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return met.where(bits <= ALL_BITS).select("a", "b")


def _foremost(groups: DataFrame) -> DataFrame:
    """``a, b``: for each document those that most of its buckets propose."""
    times = groups.groupBy("a", "b").agg((-F.count("*")).alias("n"))
    first = times.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b"))), 1, FOREMOST).alias("first"))
    return first.select("a", F.explode("first.b").alias("b"))


def _meeting(parts: Column, node: str) -> Column:
    """Those meetings of two of the ``parts`` in which a node takes part, so that every two nodes meet in one."""
    own = F.pmod(F.xxhash64(node), parts)
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.least(k, own) * parts + F.greatest(k, own))


def _dealt(signed: DataFrame) -> DataFrame:
    """Each document once for each block of its fingerprints: ``band, part, node, size, first, second``."""
    first, second = (F.col("words")[k].alias(c) for k, c in enumerate(("first", "second")))
    dealt = signed.select(F.explode(_keys("words")).alias("band"), "node", "size", first, second)
    large = signed.select(F.explode(_keys("words")).alias("_band")).groupBy("_band").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET)
    large = written(large, "near-copies-large")
    if large.isEmpty():
        return dealt.withColumn("part", F.lit(0).cast("long"))
    n = F.coalesce("_n", F.lit(1))
    return dealt.join(large, F.col("band") == F.col("_band"), "left").withColumn("part", F.explode(_meeting(F.ceil(n / BUCKET), "node"))).drop("_band", "_n")


def _within_families(groups: DataFrame, links: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """``a, b``: links that join the components of ``links`` as all links within families do. The two documents of a family
    of two were verified as a pair."""
    reached = connected_components(links).select(F.col("node").alias("_n"), "component")
    roots = groups.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"), F.collect_set("root").alias("roots"))  # one a bucket at most
    met = connected_components(roots.select("least", F.explode(F.array_except("roots", F.array("least"))).alias("root")), "least", "root")
    families = roots.select("node", "least").join(met.select(F.col("node").alias("_r"), F.col("component").alias("family")), F.col("least") == F.col("_r"), "left")
    own = families.select("node", F.coalesce("family", "least").alias("family")).join(reached, F.col("node") == F.col("_n"), "left").select("family", "node", F.coalesce("component", "node").alias("component"))
    own = own.join(signed.select(F.col("node").alias("_node"), "size"), F.col("node") == F.col("_node"))
    own = written(own.select("family", "node", "component", "size"), "near-copies-families")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / SHINGLES)).alias("parts")
    several = own.groupBy(F.col("family").alias("_family")).agg(F.min("component").alias("_l"), F.max("component").alias("_m"), F.count("*").alias("_n"), parts).where("_l < _m AND _n > 2")
    own = own.join(several, F.col("family") == F.col("_family")).join(texts, F.col("node") == F.col("row")).select("family", "parts", "node", "component", "text")
    sets = written(own.mapInArrow(_with_sets(shingle), "family long, parts long, node long, component long, shingles binary"), "near-copies-sets")
    met = sets.select("family", F.explode(_meeting(F.col("parts"), "node")).alias("meet"), "node", "component", "shingles")
    return met.repartition("family", "meet").sortWithinPartitions("family", "meet").mapInArrow(_joined(similarity), "a long, b long")


def components(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``row, component`` for each row of ``texts`` (``row`` unique, ``text`` binary): equal for rows linked over any steps.

    Equal sets of shingles stand for one in the search. Texts without words are linked with each other only. A document is
    first compared with a few that are near it; only families that this leaves in several components are compared whole.
    """
    bounded_batches(texts.sparkSession)
    rows = written(texts.select("row", "text").mapInArrow(_signed(shingle), "row long, digest binary, size long, words array<long>"), "near-copies")
    nodes = written(rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("row").alias("node")), "near-copies-nodes")
    signed = written(rows.where("size > 0").join(nodes, F.col("row") == F.col("node")).select("node", "size", "words"), "near-copies-fingerprints")
    dealt = _dealt(signed).repartition(*KEY).sortWithinPartitions(*KEY)
    groups = written(dealt.select(*KEY, "node", "size", "first", "second").mapInArrow(_proposed(similarity), "root long, a long, b long"), "near-copies-groups")
    pairs = written(_likely(_foremost(groups), signed), "near-copies-pairs")
    links = written(_verified(pairs, texts, shingle, similarity).where("near").select("a", "b"), "near-copies-links")
    links = links.union(written(_within_families(groups, links, signed, texts, shingle, similarity, block), "near-copies-met"))
    reached = connected_components(links).select(F.col("node").alias("_n"), "component")
    own = nodes.join(reached, F.col("node") == F.col("_n"), "left").select("_digest", F.coalesce("component", "node").alias("component"))
    return rows.select("row", "digest").join(own, F.col("digest") == F.col("_digest")).select("row", "component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id, columns as they are.

    A null doc_id comes last; of rows that share the smallest, one stays. Rows count by themselves, whatever their doc_id.
    Null, empty and blank texts are copies of each other; texts of any length are compared whole. An empty table gives an
    empty table; columns may have any names.
    """
    names = docs.columns
    table = docs.select(F.monotonically_increasing_id().alias("row"), carried(docs, names).alias("kept"))
    table = written(table, "near-copies-documents")
    doc_id, text = (F.col(f"kept.c{names.index(c)}") for c in ("doc_id", "text"))
    found = components(table.select("row", text_bytes(text).alias("text")), shingle, similarity)
    ids = table.select(F.col("row").alias("_row"), doc_id.alias("doc_id"))
    ids = written(found.join(ids, F.col("row") == F.col("_row")).select("row", "doc_id", "component"), "near-copies-ids")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("_first"))
    return table.join(first.select(F.col("_first.row").alias("_kept")), F.col("row") == F.col("_kept"), "left_semi").select(*restored("kept", names))
