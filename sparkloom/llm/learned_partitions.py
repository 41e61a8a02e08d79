"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a sample is cut into balanced parts with few edges between them, and a small classifier learns to
tell a vector's part (Dong et al., ICLR 2020). Every vector is stored in its most probable part; a query is routed to the
few parts that are most probable for it and its distances there are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, whole_groups, written
from sparkloom.llm.multi_index import comparable, least, matrix, squares

#: One part for so many vectors, between these numbers of parts; beyond two million vectors parts grow with the table.
PER_PART, LEAST_PARTS, MOST_PARTS = 500, 4, 4096
#: The parts and the classifier are fitted to about so many vectors, taken by a hash: SAMPLE, or more for many parts; never
#: more than SAMPLE_BYTES of them. And neighbours in their graph.
SAMPLE, SAMPLE_PER_PART, SAMPLE_BYTES, GRAPH_NEIGHBOURS = 8192, 16, 128 << 20, 10
#: Queries whose true neighbours among all vectors set the number of parts that queries visit, and the recall they reach.
TRIALS, TARGET_RECALL = 100, 0.96
#: Vectors and queries that meet in one group; fuller parts are cut into blocks of these sizes.
ROW_BLOCK, QUERY_BLOCK = 8192, 2048
#: Distances that the driver holds at once while it makes the sample's graph, whatever the sample's size.
GRAPH_CELLS = 1 << 20

KEY = ["part", "block", "asked"]


def neighbour_graph(points: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """Numbers of each point's k nearest others."""
    k = min(k, len(points) - 1)
    found = np.zeros((len(points), k), dtype=np.int64)
    norms = np.einsum("ij,ij->i", points, points)
    step = max(1, GRAPH_CELLS // len(points))
    for at in range(0, len(points) if k else 0, step):
        d = (-2 * points[at : at + step]) @ points.T  # without the point's own square, which is the same for all
        d += norms
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        found[at : at + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each point, none above ``slack`` times the mean size, with many edges inside parts.

    Starts from slices along random directions, halved again and again; then points move, in turn, to the part of most
    of their neighbours while it has room.
    """
    own = np.zeros(len(points), dtype=np.int64)
    groups = [(np.arange(len(points)), parts)]
    done = 0
    while groups:
        members, n = groups.pop()
        if n == 1:
            own[members], done = done, done + 1
            continue
        part = points[members]
        part -= part.mean(axis=0)
        direction = rng.standard_normal(points.shape[1])
        for _ in range(10):  # the direction of most variance
            direction = part.T @ (part @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = members[np.argsort(part @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        groups += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    back = np.argsort(graph, axis=None, kind="stable") // max(1, graph.shape[1])  # whose neighbour a point is
    start = np.concatenate(([0], np.cumsum(np.bincount(graph.ravel(), minlength=len(points)))))
    room = int(np.ceil(len(points) / parts * slack))
    sizes = np.bincount(own, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(len(points)):
            near = np.concatenate((graph[i], back[start[i] : start[i + 1]]))
            votes = np.bincount(own[near], minlength=parts).astype(float)
            votes[(sizes >= room) & (np.arange(parts) != own[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[own[i]]:
                sizes[own[i]] -= 1
                sizes[best] += 1
                own[i], moved = best, moved + 1
        if not moved:
            break
    return own


class Router:
    """A network with one hidden layer that gives each part's probability for a vector."""

    def __init__(self, points: np.ndarray, parts: int, seed: int = 7, hidden: int = 128, epochs: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.middle, self.scale = points.mean(axis=0), points.std() or 1.0
        graph = neighbour_graph(points)
        self.parts = parts = max(1, min(parts, len(points)))
        own = balanced_parts(points, graph, parts, rng)
        # a vector is to be sought where it and its neighbours are
        sought = np.concatenate((own[:, None], own[graph]), axis=1)
        self._train(points, sought, hidden, epochs, rng)

    def _train(self, points: np.ndarray, sought: np.ndarray, hidden: int, epochs: int, rng: np.random.Generator) -> None:
        """``sought``: parts of each point, which are to be equally probable."""
        shapes = [(points.shape[1], hidden), (hidden,), (hidden, self.parts), (self.parts,)]
        self.w = [rng.standard_normal(s) * (2 / s[0]) ** 0.5 if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(points)), max(1, len(points) // 256)):
                x = (points[rows] - self.middle) / self.scale
                a = np.maximum(x @ self.w[0] + self.w[1], 0)
                error = self._soft(a @ self.w[2] + self.w[3])
                np.add.at(error, (np.arange(len(rows))[:, None], sought[rows]), -1 / sought.shape[1])
                error /= len(rows)
                back = (error @ self.w[2].T) * (a > 0)
                step += 1
                for k, g in enumerate((x.T @ back, back.sum(axis=0), a.T @ error, error.sum(axis=0))):
                    g = g + 1e-4 * self.w[k] * (k % 2 == 0)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 3e-3 * (1 - epoch / epochs)
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def order(self, points: np.ndarray) -> np.ndarray:
        """The parts for each vector, most probable first."""
        return np.argsort(-self._logits(points), axis=1, kind="stable")

    def first(self, points: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        return least(-self._logits(points), 1)

    def _logits(self, points: np.ndarray) -> np.ndarray:
        return np.maximum((points - self.middle) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, node: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the numbers of its k nearest rows, ties to the smaller id, and their exact distances.

    Products of matrices find all rows that could be among the k; the differences of those are summed anew.
    """
    scale = np.abs(rows).max(initial=1.0) ** 2 * rows.shape[1]
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        approximate = squares(some, rows)
        kth = np.partition(approximate, min(k, len(rows) - 1), axis=1)[:, min(k, len(rows) - 1)]  # one more than k: the query itself may be there
        slack = 1e-9 * (scale + np.abs(some).max(initial=1.0) ** 2 * rows.shape[1])
        for q, (line, limit) in enumerate(zip(approximate, kth, strict=True)):
            able = np.flatnonzero((line <= limit + slack) & (node != own[at + q]))
            exact = np.sqrt(((rows[able] - some[q]) ** 2).sum(axis=1))
            best = np.lexsort((ids[able], exact))[:k]
            yield able[best], exact[best]


def _routed(router, visits: int | None = None, sizes: np.ndarray | None = None, enough: int = 0) -> Callable:
    """Adds ``parts``: the most probable part, or for queries the ``visits`` most probable ones, and more of them where
    these hold fewer than ``enough`` rows by the ``sizes`` of all parts."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("embedding")).astype(np.float64)
            if visits is None:
                parts = list(router.value.first(points).astype(np.int32))
            else:
                order = router.value.order(points)
                short = (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1
                parts = [row[: max(visits, n)].astype(np.int32) for row, n in zip(order, short, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    return routed


def _trial(queries) -> Callable:
    """Each task's nearest vectors of the few trial queries."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, points, k = queries.value
        for batch in batches:
            node, part = batch.column("node").to_numpy(), batch.column("part").to_numpy()
            found = nearest(points, own, matrix(batch.column("embedding")).astype(np.float64), node, node, k)
            for q, (rows, distance) in zip(own, found, strict=True):
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(node[rows]), pa.array(part[rows]), pa.array(distance)], names=["query", "node", "part", "score"])

    return tried


def _ranked(k: int) -> Callable:
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEY, rows=4096):
            keys = [table.column(c).to_numpy() for c in KEY]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            is_query, node = table.column("is_query").to_numpy(), table.column("node").to_numpy()
            ids = table.column("vec_id").combine_chunks()
            order_ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            vectors = table.column("embedding").combine_chunks()
            for a, b in zip([0, *change], [*change, table.num_rows], strict=True):
                asks, rows = a + np.flatnonzero(is_query[a:b]), a + np.flatnonzero(~is_query[a:b])
                if not len(asks) or not len(rows):
                    continue
                query, point = (matrix(vectors.take(pa.array(x))).astype(np.float64) for x in (asks, rows))
                found = list(nearest(query, node[asks], point, node[rows], order_ids[rows], k))
                n = [len(best) for best, _ in found]
                at = rows[np.concatenate([best for best, _ in found])]
                who = pa.array(np.repeat(asks, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[asks], n)), ids.take(who), ids.take(pa.array(at)), pa.array(np.concatenate([d for _, d in found]))], names=["query", "query_id", "vec_id", "score"])

    return ranked


def _ranks(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(sizes: dict[int, int], parts: int, size: int) -> Column:
    """The number of blocks that a part's rows make, as one constant of all parts, which are of a bounded number."""
    blocks = F.split(F.lit(" ".join(str(max(1, -(-sizes.get(p, 0) // size))) for p in range(parts))), " ")
    return F.element_at(blocks, F.col("part") + 1).cast("long")


def search(embeddings: DataFrame, is_query: Column, k: int = 10, target: float = TARGET_RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` the k nearest other rows found, by Euclidean distance.

    Ties go to the smaller vec_id, null last. Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors are compared with those of their own length. Rows with equal ids are rows of their own: a
    query's own row alone is left out. A query whose parts hold fewer than k others goes on to further ones, so it gets k
    rows, or all there are. An empty table, or one without queries, gives an empty table. Other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query"), F.size("embedding").alias("dim"))
    rows = written(rows.where(comparable(F.col("embedding"))).withColumn("node", F.monotonically_increasing_id()), "partitions-vectors")
    kinds = [(r["dim"], r["n"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    found = [_searched(rows.where(F.col("dim") == dim).drop("dim"), dim, n, k, target) for dim, n in kinds]
    schema = "query_id long, rank int, vec_id long, score double"
    out = embeddings.sparkSession.createDataFrame([], schema)
    for part in found:
        out = out.union(part)
    return out


def _vectors(rows: DataFrame, dim: int) -> np.ndarray:
    return matrix(rows.toArrow().column(0).combine_chunks()).astype(np.float64).reshape(-1, dim)


def _searched(rows: DataFrame, dim: int, n: int, k: int, target: float) -> DataFrame:
    spark = rows.sparkSession
    bounded_batches(spark)
    parts = int(np.clip(n // PER_PART, LEAST_PARTS, MOST_PARTS))
    size = max(parts, min(max(SAMPLE, SAMPLE_PER_PART * parts), SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, size / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").limit(2 * size)
    sample = _vectors(sample, dim)
    if not len(sample):  # fewer rows than a hash can miss
        sample = _vectors(rows.limit(size).select("embedding"), dim)
    sample = sample[np.lexsort(sample.T[: min(4, dim)])]
    fitted = Router(sample, parts)
    router = spark.sparkContext.broadcast(fitted)
    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, embedding {kind}, is_query boolean, node long, parts array<int>"
    coded = rows.select("vec_id", "embedding", "is_query", "node").mapInArrow(_routed(router, None), schema)
    coded = written(coded.withColumn("part", F.col("parts")[0]).drop("parts"), "partitions-index")
    visits = _visits(coded, fitted, k, target)
    held = {r["part"]: r["n"] for r in coded.groupBy("part").agg(F.count("*").alias("n")).collect()}  # as many as there are parts
    sizes = np.array([held.get(p, 0) for p in range(fitted.parts)])
    routed = _routed(router, visits, sizes, k + 1)  # the query itself is in one of them
    asking = written(rows.where("is_query").select("vec_id", "embedding", "is_query", "node").mapInArrow(routed, schema), "partitions-queries")
    asks = asking.select("vec_id", "embedding", "is_query", "node", F.explode("parts").alias("part"))
    asked = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    row_blocks, query_blocks = (_blocks(x, fitted.parts, size) for x, size in ((held, ROW_BLOCK), (asked, QUERY_BLOCK)))
    some = lambda blocks: F.array(F.pmod(F.xxhash64("node"), blocks))
    every = lambda blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
    columns = ["vec_id", "embedding", "node", "part"]
    listed = coded.select(*columns, F.lit(False).alias("is_query"), F.explode(some(row_blocks)).alias("block")).withColumn("asked", F.explode(every(query_blocks)))
    asks = asks.select(*columns, F.lit(True).alias("is_query"), F.explode(every(row_blocks)).alias("block")).withColumn("asked", F.explode(some(query_blocks)))
    met = listed.unionByName(asks).repartition(*KEY).sortWithinPartitions(*KEY)
    near = met.mapInArrow(_ranked(k), "query long, query_id long, vec_id long, score double")
    return _ranks(near, "query", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visits(coded: DataFrame, router: Router, k: int, target: float) -> int:
    """How many parts a query visits: enough for the target recall of TRIALS queries against brute force over all rows."""
    spark = coded.sparkSession
    trials = coded.where("is_query").orderBy(F.xxhash64("node"), "node").limit(TRIALS).select("node", "embedding").toArrow()
    if not trials.num_rows:
        return 1
    own = trials.column("node").to_numpy()
    points = matrix(trials.column("embedding").combine_chunks()).astype(np.float64)
    near = coded.select("node", "embedding", "part").mapInArrow(_trial(spark.sparkContext.broadcast((own, points, k))), "query long, node long, part int, score double")
    true = _ranks(near.withColumn("vec_id", F.col("node")), "query", k).select("query", "part").toArrow()
    order = dict(zip(own.tolist(), router.order(points), strict=True))
    ranks = np.array([np.flatnonzero(order[q] == p)[0] for q, p in zip(true.column("query").to_pylist(), true.column("part").to_pylist(), strict=True)] or [0])
    recall = (ranks[:, None] <= np.arange(router.parts)).mean(axis=0)
    return int(np.flatnonzero(recall >= target)[0]) + 1
