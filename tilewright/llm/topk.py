"""Exact top-k search by inner product: a ball tree per shard, branch and bound, the current kth score shared.

Vectors are quantised to whole numbers, so scores are exact. Rows are put into cells of space, by a k-means tree that is
fitted on a bounded sample, and a cell is cut into shards of about ``vectors.BLOCK`` rows. Each shard's ball tree is
built once and written. A query first searches shards of its own cell; its kth score then goes with it everywhere. The
bound q.c + |q| r of a cell's ball decides, before any vectors are sent, which cells it still has to search. In a shard
the balls stand in order of their bounds; a query leaves at the first one whose bound is below its kth score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import vectors as V
from tilewright.llm.ann import by_dim, fit_forest
from tilewright.session import stage

#: Rows of a ball that is not split; shards of its cell that a query visits first.
LEAF, GROUP = 64, 16
#: No score yet.
NONE = np.iinfo(np.int64).min


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers; beyond 62 bits they stay there."""
    return np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact; those that a long can't hold become the nearest that it can."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, start, end, parent, centre, radius) of the balls, parents first.

    A ball of more than ``leaf`` rows is halved along the line between two rows far from each other.
    """
    order, start, end, parent, centres, radii = np.arange(len(x)), [], [], [], [], []
    todo = [(0, len(x), -1)]
    while todo:
        a, b, up = todo.pop()
        rows = x[order[a:b]].astype(float)
        centre = rows.mean(0)
        far = np.sqrt(((rows - centre) ** 2).sum(1))
        start.append(a), end.append(b), parent.append(up), centres.append(centre), radii.append(far.max())
        if b - a > leaf and far.max() > 0:
            p = rows[far.argmax()]
            q = rows[((rows - p) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (q - p), half)]
            me = len(start) - 1
            todo += [(a, a + half, me), (a + half, b, me)]
    return order, np.array(start), np.array(end), np.array(parent), np.array(centres), np.array(radii)


def ball_bounds(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bound of each query's inner products within each ball, with room for rounding: none is below a score it covers."""
    product = q.astype(float) @ centre.T
    return product + norm[:, None] * radius * (1 + 1e-9) + 1e-9 * (np.abs(product) + norm[:, None] * (np.sqrt((centre**2).sum(1)) + 1) + 1)


class Search:
    """The best k so far of a block of queries, over the shards visited; ``repeat``: ids may repeat, and each counts once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, kth: np.ndarray | None = None, repeat: bool = False):
        self.ids, self.x, self.k, self.repeat = ids, x, k, repeat
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), NONE) if kth is None else kth
        self.visited = 0

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def shard(self, ids: np.ndarray, x: np.ndarray, tree: tuple | None = None) -> None:
        order, start, end, parent, centre, radius = tree or ball_tree(x)
        bound = ball_bounds(self.x, self.norm, centre, radius)
        for n in range(1, len(parent)):
            bound[:, n] = np.minimum(bound[:, n], bound[:, parent[n]])
        leaves = np.setdiff1d(np.arange(len(parent)), parent)
        bound = bound[:, leaves]
        first = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(self.ids))
        for turn in range(len(leaves)):
            at = first[active, turn]
            stay = bound[active, at] >= self.kth()[active]
            active, at = active[stay], at[stay]
            if not len(active):
                return
            for n in np.unique(at):
                mine = active[at == n]
                rows = order[start[leaves[n]] : end[leaves[n]]]
                self.visited += len(mine)
                self.offer(mine, ids[rows], dots(self.x[mine], x[rows]))

    def offer(self, mine: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.where(self.ids[mine][:, None] == ids, NONE, score)
        near = (score >= self.kth()[mine][:, None]).any(1)
        mine, score = mine[near], score[near]
        every = np.concatenate([self.score[mine], score], 1)
        vec = np.concatenate([self.vec[mine], np.broadcast_to(ids, score.shape)], 1)
        vec = np.where(every == NONE, np.iinfo(np.int64).max, vec)
        if self.repeat:  # of rows that repeat an id the best counts
            order = np.lexsort((~every, vec), axis=1)
            of = np.take_along_axis(vec, order, 1)
            again = np.zeros(vec.shape, bool)
            np.put_along_axis(again, order[:, 1:], of[:, 1:] == of[:, :-1], 1)
            every, vec = np.where(again, NONE, every), np.where(again, np.iinfo(np.int64).max, vec)
        top = np.lexsort((vec, ~every), axis=1)[:, : self.k]  # ~ turns the order round without overflow
        self.score[mine], self.vec[mine] = np.take_along_axis(every, top, 1), np.take_along_axis(vec, top, 1)

    def found(self) -> pa.Table:
        q, r = np.nonzero(self.score != NONE)
        return V.batches_of(self.ids[q], self.vec[q, r], self.score[q, r], pa.int64())


def top_k(df: DataFrame, k: int = 5, query_step: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with all rows but its own: query_id, rank, vec_id, score (long).

    Queries are the rows whose id is divisible by ``query_step``. Components become floor(scale * x). Vectors that are
    null, empty, or hold null or non-finite components take no part, nor do null ids; a query meets vectors of its own
    length only. A query with fewer than k candidates gets all; ties go to the smaller id. Rows that repeat an id are one
    query and one candidate, which have the best score of any two of their rows; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = V.usable(df, id_column, vector).select("id", "dim", "vector")
    is_query = F.col("id") % query_step == 0
    n, widest = rows.agg(F.count("*"), F.max("dim")).first()
    # Cells of about BLOCK rows, as far as the sample goes.
    trees = spark.sparkContext.broadcast(fit_forest(rows, n, widest or 1, lambda x: np.floor(x * scale), max(LEAF, V.BLOCK * min(n, 16_384) // max(n, 1))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far, out = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), [None] * b.num_rows
            for d, at, x in by_dim(b):
                x = quantised(x, scale).astype(float)
                if d in trees.value:
                    cell[at] = trees.value[d].leaf_of(x)
                centre = trees.value[d].centres[cell[at]] if d in trees.value else np.zeros((1, d))
                far[at] = np.sqrt(((x - centre) ** 2).sum(1))
                for i, v in zip(at.tolist(), x, strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64())), b.column(3), pa.array(cell), pa.array(far)], ["id", "dim", "vector", "uid", "cell", "far"])

    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    index = stage(numbered.mapInArrow(place, "id long, dim int, vector array<double>, uid long, cell int, far double"), "topk-index")
    repeat = not index.groupBy("id").count().where("count > 1").isEmpty()
    cells = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    parts = cells.select("dim", "cell", F.ceil(F.col("n") / F.lit(V.BLOCK)).cast("int").alias("parts"))
    deal = lambda d: F.pmod(F.xxhash64("uid"), d).cast("int")

    def shard(rows: pa.Table) -> pa.Table:
        ids, x = rows.column("id").to_numpy(), V.rows_of(rows.column("vector"))
        order = np.argsort(ids, kind="stable")
        values = {"ids": ids[order].tobytes(), "vectors": x[order].tobytes(), "tree": pickle.dumps(ball_tree(x[order].astype(np.int64)))}
        return pa.table({c: rows.column(c)[:1] for c in ("dim", "cell", "part")} | {c: pa.array([v], pa.binary()) for c, v in values.items()})

    dealt = index.join(parts, ["dim", "cell"]).withColumn("part", deal(F.col("parts"))).select("dim", "cell", "part", "id", "vector")
    data = stage(dealt.groupBy("dim", "cell", "part").applyInArrow(shard, "dim int, cell int, part int, ids binary, vectors binary, tree binary"), "topk-shards")

    def visit(shards: pa.Table, asked: pa.Table, share_kth: bool) -> pa.Table:
        if not shards.num_rows or not asked.num_rows:
            return V.batches_of([], [], [], pa.int64())
        ids, x = asked.column("id").to_numpy(), V.rows_of(asked.column("vector")).astype(np.int64)
        search = Search(ids, x, k, asked.column("kth").to_numpy().copy() if share_kth else None, repeat)
        for i, v, tree in zip(*(shards.column(c).to_pylist() for c in ("ids", "vectors", "tree")), strict=True):
            i, v = V.unpack(i, v)
            search.shard(i, v.astype(np.int64), pickle.loads(tree))
        return search.found()

    out, own = "query_id long, vec_id long, score long", ["dim", "cell", "group"]
    asked = index.where(is_query).join(parts, ["dim", "cell"]).withColumn("group", deal(F.ceil(F.col("parts") / F.lit(GROUP))))
    asked = stage(asked.select(*own, "id", "uid", "vector"), "topk-queries")
    at_home = data.withColumn("group", F.floor(F.col("part") / F.lit(GROUP)).cast("int"))
    # At home too a group's shards are sent once for each BLOCK of queries.
    blocks = asked.join(V.parts_of(asked, *own, name="asks"), own).withColumn("asks", deal(F.col("asks")))
    meet = [*own, "asks"]

    def met(queries: DataFrame, share_kth: bool) -> DataFrame:
        """What queries (dim, cell, group, asks, id, vector, kth) find in the shards of their group."""
        sent = at_home.join(queries.select(*meet).distinct(), own).select(*[F.col(c).alias(c) for c in (*meet, "ids", "vectors", "tree")])
        return sent.groupBy(*meet).cogroup(queries.groupBy(*meet)).applyInArrow(lambda a, b: visit(a, b, share_kth), out)

    first = stage(met(stage(blocks.select(*meet, "id", "vector", F.lit(NONE).alias("kth")), "topk-home-queries"), False), "topk-home")

    # The kth id found so far for a query: what scores less can't be among its k best.
    kth = V.ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    # Cells are bounded by the sample, but for lengths that it lacks; of these only ones with queries are told.
    balls = cells.join(F.broadcast(asked.select("dim").distinct()), "dim", "left_semi").collect()
    of: dict[int, list] = {}
    for r in balls:
        centre = trees.value[r["dim"]].centres[r["cell"]] if r["dim"] in trees.value else np.zeros(r["dim"])
        of.setdefault(r["dim"], []).append((r["cell"], centre, r["radius"]))
    known = spark.sparkContext.broadcast({d: (np.array([c for c, _, _ in x], np.int32), np.array([c for _, c, _ in x]), np.array([r for _, _, r in x])) for d, x in of.items()})

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries (id, dim, vector, uid, home, group, kth) once for each cell that their bounds reach, without the vector."""
        for b in batches:
            for d, at, x in by_dim(b):
                cell, centre, radius = known.value[d]
                bound = ball_bounds(x, np.sqrt((x * x).sum(1)), centre, radius)
                r, c = np.nonzero(bound >= b.column(6).to_numpy()[at][:, None])
                yield pa.RecordBatch.from_arrays([*[b.column(v).take(pa.array(at[r])) for v in (3, 1, 4, 5, 6)], pa.array(cell[c])], ["uid", "dim", "home", "from", "kth", "cell"])

    with_kth = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "dim", "vector", "uid", F.col("cell").alias("home"), "group", F.coalesce("kth", F.lit(NONE)).alias("kth"))
    away = with_kth.mapInArrow(go, "uid long, dim int, home int, from int, kth long, cell int")
    away = away.join(parts, ["dim", "cell"]).withColumn("group", F.explode(F.expr(f"sequence(0, cast(ceil(parts / {float(GROUP)}) as int) - 1)")))
    away = stage(away.where((F.col("home") != F.col("cell")) | (F.col("from") != F.col("group"))).select(*own, "uid", "kth"), "topk-visits")
    # Blocks of queries are counted by the visits of a group of shards, so it is sent once for each BLOCK of them.
    away = away.join(V.parts_of(away, *own, name="asks"), own).withColumn("asks", deal(F.col("asks")))
    away = stage(away.join(asked.select("uid", "id", "vector"), "uid").select(*meet, "id", "vector", "kth"), "topk-away")
    return V.ranked(first.union(met(away, True)), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), b as (
  select query_id, vec_id, max(score) as score from s group by all
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from b
)
select * from r where rank <= 5
"""
