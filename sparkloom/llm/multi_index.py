"""Near-duplicate embeddings by an inverted multi-index.

Each half of a normalised vector has its own codebook, and pairs of codewords form a grid of cells. A vector is listed in
its home cell and visits the cells nearest to it, in the order of the multi-sequence traversal (Babenko and Lempitsky,
CVPR 2012), until vectors as far away as the threshold allows are met with the target recall. Meetings in a cell are
verified by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, whole_groups, written
from sparkloom.llm.components import connected_components, local_roots

#: One codeword in a half for so many vectors in its square, so cells stay small as the table grows: up to two billion
#: vectors of each length at MOST_CODEWORDS.
PER_CELL, MOST_CODEWORDS = 32, 8192
#: The codebooks are fitted to about so many vectors, taken by a hash: SAMPLE, or more for many codewords; never more
#: than SAMPLE_BYTES of them.
SAMPLE, PER_CODEWORD, SAMPLE_BYTES = 20_000, 8, 256 << 20
#: Share of pairs at the threshold itself that are to meet; closer pairs meet more often.
TARGET_RECALL = 0.995
#: Clusters of the sample that count as regions; the sample's vectors that make a region or label large, and are tried of it.
REGIONS, TRIALS = 16, 1000
#: Vectors of a cell that meet at once; a fuller cell is cut into blocks, and every two blocks meet.
BLOCK = 512

KEY = ["label", "dim", "cell", "left", "right"]


def comparable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all of them zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codebook(points: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of k-means over the sample."""
    centres = points[rng.choice(len(points), size, replace=False)]
    for _ in range(rounds):
        own = closest(points, centres)
        n = np.bincount(own, minlength=size)
        sums = np.stack([np.bincount(own, points[:, d], minlength=size) for d in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)


def closest(points: np.ndarray, centres: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The number of each point's nearest centre."""
    return np.concatenate([squares(points[k : k + rows], centres).argmin(axis=1) for k in range(0, len(points), rows)])


def least(distances: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` least of each row, in order."""
    if n < distances.shape[1] // 4:  # no need to sort all
        first = np.sort(np.argpartition(distances, n - 1, axis=1)[:, :n], axis=1)
        return np.take_along_axis(first, np.take_along_axis(distances, first, axis=1).argsort(axis=1, kind="stable"), axis=1)
    return distances.argsort(axis=1, kind="stable")[:, :n]


class Grid:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, target: float = TARGET_RECALL, seed: int = 7, labels: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        self.codewords = max(1, min(codewords, len(sample)))
        self.books = [codebook(part, self.codewords, rng) for part in self._halves(sample)]
        order = rng.permutation(len(sample))  # the sample comes sorted
        groups = self._groups(sample[order], None if labels is None else labels[order], rng)
        self.visits = self._enough(sample[order], groups, threshold, target, rng)

    @staticmethod
    def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = vectors.shape[1] // 2
        return (vectors[:, :half], vectors[:, half:]) if half else (vectors, vectors)

    def _distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [squares(part, book) for part, book in zip(self._halves(vectors), self.books, strict=True)]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (closest(part, book) for part, book in zip(self._halves(vectors), self.books, strict=True))
        return first * self.codewords + second

    def nearest(self, vectors: np.ndarray, n: int | None = None) -> np.ndarray:
        """The first ``n`` cells of each vector's multi-sequence traversal: those of least summed distance, home first.

        A cell at ranks i and j of the halves can only be among the first n if i * j <= n, so only those are compared.
        """
        n = min(self.visits if n is None else n, self.codewords**2)
        rank = min(n, self.codewords)
        i, j = np.indices((rank, rank)).reshape(2, -1)
        i, j = i[(i + 1) * (j + 1) <= n], j[(i + 1) * (j + 1) <= n]
        order, near = zip(*((o := least(d, rank), np.take_along_axis(d, o, axis=1)) for d in self._distances(vectors)), strict=True)
        total = near[0][:, i] + near[1][:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(order[0][:, i], first, axis=1) * self.codewords + np.take_along_axis(order[1][:, j], first, axis=1)

    @staticmethod
    def _groups(sample: np.ndarray, labels: np.ndarray | None, rng: np.random.Generator) -> list[np.ndarray]:
        """Trial vectors of all the sample, of each large region and of each large label; the sample is in random order."""
        regions = closest(sample, codebook(sample, min(REGIONS, len(sample)), rng))
        kinds = [regions] if labels is None else [regions, labels]
        large = [at for kind in kinds for x in np.unique(kind) if len(at := np.flatnonzero(kind == x)) >= TRIALS]
        return [np.arange(min(2000, len(sample))), *(at[:TRIALS] for at in large)]

    def _enough(self, sample: np.ndarray, groups: list[np.ndarray], threshold: float, target: float, rng: np.random.Generator) -> int:
        """Cells after which pairs at the threshold have met, either way, with the target recall in each of ``groups``;
        tried on their vectors of the sample and on neighbours made at that very distance."""
        tried = np.unique(np.concatenate(groups))
        groups = [np.searchsorted(tried, at) for at in groups]
        sample = sample[tried]
        aside = rng.standard_normal(sample.shape)
        aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
        size = np.linalg.norm(aside, axis=1, keepdims=True)  # 0 in one dimension, where nothing is aside
        others = threshold * sample + np.sqrt(1 - threshold**2) * aside / np.where(size > 0, size, 1.0)
        homes = self.home(sample), self.home(others)
        met = np.zeros(len(sample), dtype=bool)
        n = 1
        while n < self.codewords**2:
            left = np.flatnonzero(~met)  # what has met stays met
            for at in (left[k : k + 2000] for k in range(0, len(left), 2000)):
                there, back = self.nearest(sample[at], n) == homes[1][at, None], self.nearest(others[at], n) == homes[0][at, None]
                met[at] = there.any(axis=1) | back.any(axis=1)
            if all(met[at].mean() >= target for at in groups):
                break
            n = n + 1 if n < 8 else n + n // 4
        return min(n, self.codewords**2)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coder(grids) -> Callable:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                cells = grids.value[int(dim)].nearest(unit(matrix(rows.column("embedding"))))
                visits = pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells[:, 0].astype(np.int32)), visits], names=[*rows.schema.names, "home", "visits"])

    return coded


def fitted_grids(vectors: DataFrame, threshold: float) -> dict[int, Grid]:
    """A grid for each length of vectors, fitted to a bounded sample of them."""
    grids = {}
    for dim, n in ((r["dim"], r["n"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        codewords = int(np.clip(np.sqrt(n / PER_CELL), 1, MOST_CODEWORDS))
        size = max(1, min(max(SAMPLE, PER_CODEWORD * codewords), SAMPLE_BYTES // (8 * dim)))
        share = min(1.0, size / n)
        rows = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit("sample"), "embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        taken = rows.select("embedding", "label").limit(2 * size).toArrow()
        sample = unit(matrix(taken.column(0).combine_chunks()).reshape(-1, dim))
        labels = taken.column(1).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort(sample.T[:4])
        sample, labels = sample[order], labels[order]
        grids[dim] = Grid(sample, codewords, threshold, labels=labels)
    return grids


def _meetings(threshold: float) -> Callable:
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, KEY):
            keys = [rows.column(k).to_numpy() for k in KEY]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            columns = {k: rows.column(k).combine_chunks() for k in ("embedding", "visits")}
            plain = {k: rows.column(k).to_numpy() for k in ("node", "copies", "home", "member")}
            out = []
            for a, b in zip([0, *change], [*change, rows.num_rows], strict=True):
                listed = a + np.flatnonzero(plain["member"][a:b])
                guests = a + np.flatnonzero(~plain["member"][a:b])
                if len(listed) and len(guests):
                    out.append(_met(listed, guests, columns, plain, threshold))
            if out:
                node, links, root = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    return met


def _met(listed: np.ndarray, guests: np.ndarray, columns: dict, plain: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links among the guests and the vectors listed in a cell's block; links that are counted here; the
    smallest node that each is linked to here over any number of steps."""
    node, copies, home = plain["node"], plain["copies"], plain["home"]
    vectors = [unit(matrix(columns["embedding"].take(pa.array(x)))) for x in (guests, listed)]
    g, m = np.nonzero(vectors[0] @ vectors[1].T >= threshold)
    g, m = guests[g], listed[m]
    g, m = g[node[g] != node[m]], m[node[g] != node[m]]
    if not len(g):
        return node[:0], copies[:0], node[:0]
    # a guest counts its links; a listed vector counts those to guests whose home it does not visit itself
    visits = matrix(columns["visits"].take(pa.array(listed)))
    unmet = ~(visits[np.searchsorted(listed, m)] == home[g][:, None]).any(axis=1)
    who = np.concatenate((node[g], node[m]))
    count = np.concatenate((copies[m], np.where(unmet, copies[g], 0)))
    nodes, at = np.unique(who, return_inverse=True)
    links = np.bincount(at, count, minlength=len(nodes)).astype(np.int64)
    return nodes, links, nodes[local_roots(at[: len(g)], at[len(g) :], len(nodes))]


def meetings(coded: DataFrame, block: int = BLOCK) -> DataFrame:
    """The vectors of ``coded`` dealt to their cells: as listed in the home cell, as a guest in each visited one.

    A cell with more than ``block`` of either is cut into blocks, and each block of listed vectors meets each of guests.
    """
    where = ["label", "dim"]
    listed = coded.groupBy(*where, F.col("home").alias("cell")).agg(F.count("*").alias("_m"))
    guests = coded.select(*where, F.explode("visits").alias("cell")).groupBy(*where, "cell").agg(F.count("*").alias("_g"))
    full = listed.join(guests, [*where, "cell"]).where((F.col("_m") > block) | (F.col("_g") > block))
    full = full.select(*(F.col(c).alias(f"_{c}") for c in (*where, "cell")), F.ceil(F.col("_m") / block).alias("_ms"), F.ceil(F.col("_g") / block).alias("_gs"))
    full = written(full, "multi-index-full")
    same = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))
    own = ["node", "copies", "embedding", "home"]
    listed = coded.select(*where, F.col("home").alias("cell"), *own, F.lit(True).alias("member"), "visits")
    guests = coded.select(*where, F.explode("visits").alias("cell"), *own, F.lit(False).alias("member"), F.lit(None).cast("array<int>").alias("visits"))
    rows = listed.union(guests).join(full, same, "left")
    ms, gs = (F.coalesce(F.col(c), F.lit(1).cast("long")) for c in ("_ms", "_gs"))
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rows = rows.withColumn("left", F.explode(F.when(F.col("member"), F.array(part(ms))).otherwise(every(ms))))
    rows = rows.withColumn("right", F.explode(F.when(F.col("member"), every(gs)).otherwise(F.array(part(gs)))))
    return rows.select(*KEY, *own, "member", "visits")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``embeddings``.

    Vectors are compared if their labels are equal and not null and their lengths are equal. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and so do vectors without a label; each is its
    own component. Equal vectors stand for one in the search and are all linked; so ties and repeated rows each count. A
    null vec_id is never the smallest unless alone. An empty table gives an empty table. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", F.col("label"), F.col("embedding"), F.size("embedding").alias("dim"))
    able = F.col("label").isNotNull() & comparable(F.col("embedding"))
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(able)
    distinct = rows.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "multi-index-vectors")
    keys = distinct.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "node")
    nodes = rows.join(keys, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "node")
    grids = spark.sparkContext.broadcast(fitted_grids(distinct, threshold))
    bounded_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    columns = ["label", "dim", "node", "copies", "embedding"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", home int, visits array<int>"
    coded = written(distinct.select(*columns).mapInArrow(_coder(grids), schema), "multi-index-codes")
    dealt = meetings(coded, block).repartition(*KEY).sortWithinPartitions(*KEY)
    found = written(dealt.mapInArrow(_meetings(threshold), "node long, links long, root long"), "multi-index-links")
    reached = connected_components(found.select("node", "root"), "node", "root")
    counts = found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    vectors = distinct.select("node", "least", "copies").join(counts, F.col("node") == F.col("_n"), "left")
    vectors = vectors.join(reached.select(F.col("node").alias("_r"), "component"), F.col("node") == F.col("_r"), "left")
    vectors = written(vectors.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "multi-index-components")
    least = vectors.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("component_id"))
    vectors = written(vectors.join(least, F.col("component") == F.col("_c")).select(F.col("node").alias("_node"), "n_links", "component_id"), "multi-index-result")
    found = nodes.join(vectors, F.col("node") == F.col("_node"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(alone)
