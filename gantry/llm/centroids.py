"""Centroid clustering by dual-tree Lloyd rounds: a cover tree over vectors against a cover tree over the round's centroids.

Vectors become whole numbers, and each block of them becomes a cover tree once, written as one row: a node has a centre
among its points and a radius that covers them, its children's centres are further apart than half its radius, and
every point is within that of one of them. Each round the centroids, `clusters` times the dimension numbers, form a tree as well; a
pair of nodes is dropped when the least distance between them is above the largest to some centroid, and only leaves that
are left are compared, point by point and exactly. A task adds its vectors up by cluster, so that a round moves a row for
each cluster and dimension of each task, and the driver holds the centroids alone.

Cases: vectors of another length, with nulls, NaN or infinite components are left out, and so are those with a component so
large that a squared distance would not fit a long; null and repeated ids are vectors of their own; ties go to the smaller cluster
number; fewer vectors than clusters give as many clusters as vectors; an empty cluster stays where it is; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import materialise, release

#: Vectors of one tree; points and centroids of a leaf.
BLOCK, LEAF, FEW = 1024, 16, 2
#: Squares of whole numbers up to this size, times the dimension, are exact in double precision for every usual dimension.
_EXACT = 1 << 20


@dataclass
class CoverTree:
    """Nodes as arrays: centre (a point's place), radius, children [first, first + n) and points [start, end) in tree order."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    n: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    diff = points - to
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def cover_tree(points: np.ndarray, leaf: int) -> CoverTree:
    """A tree over the rows of `points`. A node stays a leaf where a quarter of its points would not cover the others: such points have no groups."""
    order = np.arange(len(points))
    centre, radius, first, n, start, end = [0], [0.0], [0], [0], [0], [len(points)]
    todo = [0]
    while todo:
        node = todo.pop()
        a, b = start[node], end[node]
        mine = order[a:b]
        near = _distances(points[mine], points[centre[node]])
        radius[node] = float(near.max(initial=0.0))
        if b - a <= leaf or radius[node] == 0.0:
            continue
        net, group, far = [centre[node]], np.zeros(b - a, dtype=np.int64), int(near.argmax())
        while near[far] > radius[node] / 2 and len(net) <= max((b - a) // 4, 2):
            net.append(int(mine[far]))
            d = _distances(points[mine], points[mine[far]])
            closer = d < near
            near, group = np.where(closer, d, near), np.where(closer, len(net) - 1, group)
            far = int(near.argmax())
        if near[far] > radius[node] / 2:
            continue
        by = np.argsort(group, kind="stable")
        order[a:b] = mine[by]
        ends = a + np.cumsum(np.bincount(group, minlength=len(net)))
        first[node], n[node] = len(centre), len(net)
        for c, lo, hi in zip(net, [a, *ends[:-1].tolist()], ends.tolist(), strict=True):
            todo.append(len(centre))
            for column, x in ((centre, c), (radius, 0.0), (first, 0), (n, 0), (start, lo), (end, hi)):
                column.append(x)
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    return CoverTree(order, place[centre], np.array(radius), *(np.array(x, dtype=np.int64) for x in (first, n, start, end)))


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Centroids:
    """The centroids of one round and their tree."""

    def __init__(self, rows: np.ndarray):
        self.tree = cover_tree(rows.astype(np.float64), FEW)
        self.number, self.rows = self.tree.order, rows[self.tree.order]  # in tree order
        self.centres = self.rows[self.tree.centre].astype(np.float64)

    def nearest(self, points: np.ndarray, tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
        """The number of each point's nearest centroid and the squared distance; `points` in the order of `tree`."""
        mine = self.tree
        own = points[tree.centre].astype(np.float64)
        apart = (own * own).sum(axis=1)[:, None] - 2.0 * (own @ self.centres.T) + (self.centres * self.centres).sum(axis=1)
        apart = np.sqrt(np.maximum(apart, 0.0))
        slack = 1e-6 * (1.0 + float(apart.max(initial=0.0)))  # bounds are rounded, so they only drop what is clearly farther
        cluster, distance = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
        todo = [(0, np.zeros(1, dtype=np.int64))]
        while todo:
            node, left = todo.pop()
            r = tree.radius[node]
            while True:
                d = apart[node, left]
                left = left[d - r - mine.radius[left] <= (d + r).min() + slack]
                # centroid nodes wider than this one are opened, all of them before a leaf is compared
                wide = (mine.n[left] > 0) & ((mine.radius[left] > r) | (tree.n[node] == 0))
                if not wide.any():
                    break
                opened = [np.arange(mine.first[c], mine.first[c] + mine.n[c]) for c in left[wide].tolist()]
                left = np.concatenate([left[~wide], *opened])
            if tree.n[node]:
                todo += [(child, left) for child in range(tree.first[node], tree.first[node] + tree.n[node])]
                continue
            few = np.concatenate([np.arange(mine.start[c], mine.end[c]) for c in left.tolist()])
            few = few[np.argsort(self.number[few])]  # ties go to the smaller number
            a, b = tree.start[node], tree.end[node]
            squares = _squares(points[a:b], self.rows[few])
            at = squares.argmin(axis=1)
            cluster[a:b], distance[a:b] = self.number[few[at]], squares[np.arange(b - a), at]
        return cluster, distance


_TREE = ("centre", "first", "n", "start", "end")


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id and q, floor(scale * x) of each component, of the vectors that can be used."""
    most = math.isqrt((1 << 62) // dims) // 2
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x"))
    usable = rows.where((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < most)))
    return usable.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def plant(numbers: DataFrame, dims: int) -> DataFrame:
    """One row for each block of vectors: their ids, their components and the cover tree over them, written out."""
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(numbers.schema["vec_id"].dataType)), T.StructField("points", T.BinaryType()),
        T.StructField("radius", T.BinaryType()), *(T.StructField(c, T.BinaryType()) for c in _TREE),
    ])

    def planted(ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        tree = cover_tree(q.astype(np.float64), LEAF)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(tree.order)))
        blobs = [q[tree.order].astype("<i8"), tree.radius.astype("<f8"), *(getattr(tree, c).astype("<i8") for c in _TREE)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=schema.names)

    def run(batches):
        ids, rows, held = [], [], 0
        for batch in batches:
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            for a in range(0, batch.num_rows, BLOCK):
                ids.append(batch.column(0).slice(a, BLOCK))
                rows.append(q[a : a + BLOCK])
                held += len(rows[-1])
                if held >= BLOCK:
                    yield planted(pa.concat_arrays(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
        if held:
            yield planted(pa.concat_arrays(ids), np.concatenate(rows))
        release()

    return materialise(numbers.select("vec_id", "q").mapInArrow(run, schema), "vector-trees")


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, points, clusters and distances of each block."""
    now = Centroids(centroids)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            of = lambda name, kind: np.frombuffer(row[name].as_buffer(), dtype=kind)  # noqa: B023, E731
            points = of("points", "<i8").reshape(-1, dims)
            tree = CoverTree(np.arange(len(points)), of("centre", "<i8"), of("radius", "<f8"), *(of(c, "<i8") for c in _TREE[1:]))
            yield row["ids"].values, points, *now.nearest(points, tree)


def _sums(trees: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster the number of its vectors and the exact sums of their components."""
    schema = "cluster int, count long, sums array<long>"
    k = len(centroids)

    def run(batches):
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, points, cluster, _ in _nearest(batches, centroids, dims):
            by = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(cluster[by]) > 0]))
            sums[cluster[by[at]]] += np.add.reduceat(points[by], at, axis=0)
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "count", "sums"])

    long = trees.mapInArrow(run, schema).select("cluster", "count", F.posexplode("sums").alias("dim", "x"))
    exact = long.groupBy("cluster", "dim").agg(F.sum("count").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in exact.collect():  # clusters times dimensions
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["dim"]] = int(r["x"])
    return out


def lloyd(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every usable vector, and the centroids after `rounds` rounds.

    The first centroids are the vectors of the smallest sha256 of `seed:vec_id`, a null id as nothing; vectors of one hash in order of their components.
    """
    numbers = whole_numbers(vectors, vec_id, vector, dims, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = numbers.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(clusters).collect()
    numbers = numbers.select("vec_id", "q")
    schema = T.StructType([numbers.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not first:
        return numbers.sparkSession.createDataFrame([], schema), []
    centroids = np.array([r["q"] for r in first], dtype=np.int64)
    trees = plant(numbers, dims)
    for _ in range(rounds):
        for c, (n, sums) in _sums(trees, centroids, dims).items():
            centroids[c] = [x // n for x in sums]

    def run(batches):
        for ids, _, cluster, distance in _nearest(batches, centroids, dims):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=schema.names)

    return trees.mapInArrow(run, schema), centroids.tolist()


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if not centroids:
        return assigned.select("*", *(F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    assigned = materialise(assigned, "clusters")
    sums = {r["cluster"]: int(r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, x))) for c, x in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string").withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The rounds one after another, all vectors against all centroids; each result is aggregated before the next round reads it.
def _sql(rounds: int = 5, clusters: int = 40) -> str:
    nearest = "SELECT v.rid, arg_min(c.c, [list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))), c.c]) AS c FROM v CROSS JOIN c{0} c GROUP BY v.rid"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256(concat('2:', vec_id)) AS h, q FROM v ORDER BY h, q LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT a.c, v.q, unnest(range(1, 65)) AS i FROM a{r} a JOIN v USING (rid)) GROUP BY c, i)"
            )
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS q FROM m{r} GROUP BY c) m USING (c))")
    steps.append(
        f"d AS (SELECT v.vec_id, a.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS BIGINT) AS distance, array_to_string(c.q, ',') AS t FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c USING (c))"
    )
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(t) AS centroid_sha256 FROM d"
    )


ORACLE_SQL = _sql()
