"""Centroid clustering: rounds of nearest-centroid assignment, searched through a vantage-point tree over the centroids.

Each round builds the tree of the current centroids and broadcasts it. A node of the tree is one centroid, the vantage
point, and two halves of the others, the nearer ones and the farther ones, each with the least and the greatest distance
of its members from the vantage point. A vector goes through the tree best first: of the nodes that it knows it opens the
one with the least bound, and stops at the first whose bound is above its best distance. A node whose bound equals it is
opened, for a centroid as near with a smaller number wins. Bounds are worked out in floating point and widened by more than
its error; distances at vantage points and leaves are whole numbers, so assignments are exact.

Vectors are whole numbers. Tasks send one sum for each centroid and component; Spark adds them up, and the new centroids,
k rows, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import vectors as V
from tilewright.llm.flat import in_small_batches
from tilewright.llm.topk import dots
from tilewright.session import stage

#: Components stay within this, so that any distance of up to 64 components is a long.
MOST = 1 << 27
#: Centroids of a leaf. Centroids at most, times components: they are broadcast and come to the driver.
LEAF, MOST_CENTROIDS = 4, 1 << 24


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    return dots(x * x, np.ones((1, x.shape[1]), np.int64)) + dots(c * c, np.ones((1, c.shape[1]), np.int64)).T - 2 * dots(x, c)


class Vantage:
    """The tree. ``members`` are the centroids that a node looks at itself: its vantage point, or all of a leaf.

    ``near`` and ``far`` are the numbers of its halves (0: none), each with the least and greatest distance from the point.
    """

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        self.members: list[np.ndarray] = []
        self.halves: list[list[tuple[int, float, float]]] = []
        todo: list[tuple[np.ndarray, int, float, float]] = [(np.arange(len(centroids)), -1, 0.0, 0.0)]
        while todo:
            rows, up, low, high = todo.pop()
            me = len(self.members)
            if up >= 0:
                self.halves[up].append((me, low, high))
            self.halves.append([])
            if len(rows) <= leaf:
                self.members.append(rows)
                continue
            # The point farthest from the middle parts the others best.
            middle = centroids[rows].astype(float).mean(0)
            point = rows[np.argmax(((centroids[rows] - middle) ** 2).sum(1))]
            rest = rows[rows != point]
            distance = np.sqrt(squared(centroids[[point]], centroids[rest])[0].astype(float))
            order = np.argsort(distance, kind="stable")
            self.members.append(np.array([point]))
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                if len(half):
                    todo.append((rest[half], me, float(distance[half].min()), float(distance[half].max())))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, ties to the smaller number; distances worked out."""
        n, nodes = len(x), len(self.members)
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        bound = np.full((n, nodes), np.inf)
        bound[:, 0] = 0.0
        active, looked = np.arange(n), 0
        while len(active):
            node = np.argmin(bound[active], 1)
            least = bound[active, node]
            go = least <= np.sqrt(best[active].astype(float)) * (1 + 1e-9) + 1e-9
            active, node, least = active[go], node[go], least[go]
            bound[active, node] = np.inf
            go = np.isfinite(least)
            active, node, least = active[go], node[go], least[go]
            for k in np.unique(node):
                here = node == k
                mine, members = active[here], self.members[k]
                d = squared(x[mine], self.centroids[members])
                looked += d.size
                first = np.lexsort((np.broadcast_to(members, d.shape), d), axis=1)[:, 0]
                found, number = np.take_along_axis(d, first[:, None], 1)[:, 0], members[first]
                better = (found < best[mine]) | ((found == best[mine]) & (number < at[mine]))
                best[mine[better]], at[mine[better]] = found[better], number[better]
                if self.halves[k]:
                    far = np.sqrt(d[:, 0].astype(float))
                    for child, low, high in self.halves[k]:
                        reach = np.maximum(low - far, far - high)
                        bound[mine, child] = np.maximum(least[here], reach - 1e-9 * (far + high) - 1e-9)
        return at, best, looked


def _batch(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def whole_numbers(df: DataFrame, dim: int, scale: float, id_column: str, vector: str) -> DataFrame:
    """(id, x): floor(scale * component) of vectors with ``dim`` components, none null or not finite; ids may be null."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    most = F.lit(float(MOST))
    of = F.transform(v, lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), -most), most)).cast("long"))
    return df.where(F.coalesce((F.size(v) == dim) & fine, F.lit(False))).select(F.col(f"`{id_column}`").cast("long").alias("id"), of.alias("x"))


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3, id_column: str = "vec_id", vector: str = "embedding", leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector of ``dim`` finite components, and the centroids (number, component).

    Components become floor(scale * x), those beyond 2 ** 27 stay there. Centroids start as the k vectors with the smallest
    SHA-256 of "seed:id", in this order (null ids last, equal ids by their vectors); fewer vectors give fewer centroids. A
    round puts every vector to its nearest centroid, ties to the smaller number, and moves each centroid that has vectors
    to floor(sum / count) of them. Repeated rows count each; an empty table gives an empty result.
    """
    if k * dim > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} components of centroids")
    spark = df.sparkSession
    rows = stage(in_small_batches(whole_numbers(df, dim, scale, id_column, vector)), "clusters-vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(first.asc_nulls_last(), "x").limit(k).collect()
    out = "id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], out), np.zeros((0, dim), np.int64)
    centroids = np.array([r.x for r in start], np.int64)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        total, count = np.zeros(tree.centroids.shape, np.int64), np.zeros(len(tree.centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x = _batch(b)
                at = tree.nearest(x)[0]
                count += np.bincount(at, minlength=len(count))
                for c in np.unique(at):
                    total[c] += x[at == c].sum(0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(held))), pa.array(total[held].ravel()), pa.array(np.repeat(count[held], dim))], ["cluster", "i", "total", "n"])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Vantage(centroids, leaf))
        sums = rows.mapInArrow(moved, "cluster int, i int, total long, n long").groupBy("cluster", "i")
        centroids = centroids.copy()
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            centroids[r.cluster, r.i] = int(r.total) // r.n
        shared.unpersist()
    last = spark.sparkContext.broadcast(Vantage(centroids, leaf))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, distance, _ = last.value.nearest(_batch(b))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return stage(rows.mapInArrow(assigned, out), "clusters-assigned"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    of = spark.createDataFrame([(k, ",".join(map(str, c.tolist()))) for k, c in enumerate(centroids)], "cluster int, components string")
    # A row for each centroid, with its vectors' sum; sums that a long can't hold become its largest.
    longest = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = sums.agg(F.sum("own").cast("decimal(38,0)").alias("every"))
    per = sums.crossJoin(F.broadcast(total)).join(F.broadcast(of), "cluster").select("cluster", *[F.least(F.col(c).cast("decimal(38,0)"), longest).cast("long").alias(a) for c, a in (("own", "cluster_inertia"), ("every", "inertia"))], F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """DuckDB SQL for the rows of ``query`` over a table ``embeddings``: every distance of every round."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2])::hugeint * (p[1] - p[2])))::bigint"
    parts = [
        f"v as materialized (select row_number() over () as u, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dim})",
        f"c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, x) - 1)::int as k, x from v order by k limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select v.u, arg_min(c.k, {{'d': {apart}, 'k': c.k}}) as k, min({apart}) as d from v, c{r} c group by v.u)")
        if r < rounds:
            floor = "((t - ((t % n + n) % n)) // n)::bigint"
            mean = f"select k, i, {floor} as m from (select a.k, g.i, sum(v.x[g.i])::hugeint as t, count(*)::hugeint as n from a{r} a join v using (u), (select unnest(range(1, {dim + 1})) as i) g group by a.k, g.i)"
            parts.append(f"c{r + 1} as materialized (select c.k, coalesce(m.x, c.x) as x from c{r} c left join (select k, list(m order by i) as x from ({mean}) group by k) m using (k))")
    last = f"a{rounds}"
    return f"""
with {", ".join(parts)}
select v.vec_id, a.k as cluster, a.d as distance, sum(a.d) over (partition by a.k)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from {last} a join v using (u) join c{rounds} c on c.k = a.k
"""
