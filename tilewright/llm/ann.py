"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of unit vectors; every row is then put into a leaf. A query goes through the
tree with a priority queue of nodes by distance: the nearest bin is opened first, and leaves come out in the order in
which they are visited. How many leaves are visited is widened until, for a sample of queries with known neighbours,
the share of neighbours in visited leaves reaches ``TARGET``. Queries and rows of a leaf meet in blocks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import vectors as V
from tilewright.session import stage

#: Rows that trees are fitted on, about: one of SAMPLE_STEP, but SAMPLE at least and MOST_SAMPLE at most, so leaves grow
#: with the table up to some four million rows. Queries that the width is calibrated with, about.
SAMPLE, SAMPLE_STEP, MOST_SAMPLE, CALIBRATION = 16_384, 16, 262_144, 200
#: Components of a tree's sample at most.
MOST_NUMBERS = 1 << 25
#: Children of a node, sample rows of a node that is not split, rounds of k-means, recall that the width must reach.
CHILDREN, LEAF, ROUNDS, TARGET = 8, 64, 8, 0.94


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, safe for very large and very small ones."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Centres of nodes in one matrix; ``children[n]`` is the range of a node's children, empty for a leaf."""

    def __init__(self, x: np.ndarray, seed: int = 5, leaf: int = LEAF):
        rng = np.random.default_rng(seed)
        centres, children, todo = [x.mean(0)], [(0, 0)], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            c = x[rng.choice(rows, min(CHILDREN, len(rows)), replace=False)]
            for _ in range(ROUNDS):
                near = np.argmax(x[rows] @ c.T - 0.5 * (c * c).sum(1), 1)
                c = np.array([x[rows[near == k]].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            near = np.argmax(x[rows] @ c.T - 0.5 * (c * c).sum(1), 1)
            used = np.unique(near)
            if len(used) < 2:  # all rows alike
                continue
            children[node] = (len(centres), len(centres) + len(used))
            for k in used:
                todo.append((len(centres), rows[near == k]))
                centres.append(c[k])
                children.append((0, 0))
        self.centres = np.array(centres)
        self.half = 0.5 * (self.centres**2).sum(1)
        self.children = np.array(children)
        self.leaves = np.flatnonzero(self.children[:, 0] == self.children[:, 1])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to by the nearest child."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.children[at[rows], 0] < self.children[at[rows], 1]]
            for n in np.unique(at[rows]):
                mine = rows[at[rows] == n]
                a, b = self.children[n]
                at[mine] = a + np.argmax(x[mine] @ self.centres[a:b].T - self.half[a:b], 1)
        return at

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best-bin-first search, without end until all are out."""
        far = self.half - self.centres @ q
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            a, b = self.children[n]
            if a == b:
                yield int(n)
            for c in range(a, b):
                heapq.heappush(queue, (far[c], c))


OUT = "query_id long, vec_id long, score double"
#: Queries whose candidates are scored at once, and how far below the k-th score of a matrix product a candidate may be.
AT_ONCE, MARGIN = 32, 1e-9


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, cosine) of the k nearest rows of each query, its own id left out; ties to smaller ids, each id once.

    A matrix product finds the candidates. Their scores are worked out pair by pair in one order, so they don't depend
    on what else is in a block, and equal vectors have equal scores. ``ids`` ascend; where some repeat, all rows are
    candidates, as the k-th score of rows says nothing of the k-th id.
    """
    q, x = unit(q), unit(x)
    repeat = bool((ids[1:] == ids[:-1]).any())
    out = []
    for a in range(0, len(q), AT_ONCE):
        near = np.where(q_ids[a : a + AT_ONCE, None] == ids, -np.inf, q[a : a + AT_ONCE] @ x.T)
        kth = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k and not repeat else np.full((len(near), 1), -2.0)
        r, c = np.nonzero(near >= np.maximum(kth - MARGIN, -2.0))
        score = np.clip((q[a + r] * x[c]).sum(1), -1.0, 1.0)
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        if repeat:
            once = np.sort(np.unique(np.stack([r, ids[c]]), axis=1, return_index=True)[1])
            r, c, score = r[once], c[once], score[once]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((a + r[first], c[first], score[first]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fit_forest(rows: DataFrame, n: int, widest: int, prepare, leaf: int = LEAF) -> dict[int, Tree]:
    """A tree for each length of vectors in a bounded sample of ``rows`` (id, dim, vector), ``n`` in all.

    ``prepare`` turns a matrix of vectors into what the tree is fitted on. All rows of one length in the sample go
    through one task; ``widest``, the greatest length, bounds its bytes.
    """
    most = min(max(n // SAMPLE_STEP, SAMPLE), MOST_SAMPLE, max(MOST_NUMBERS // max(widest, 1), 1))
    drawn = F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))
    sample = rows.where(drawn) if n > most else rows

    def fit(rows: pa.Table) -> pa.Table:
        x = V.rows_of(rows.column("vector"))
        ids = rows.column("id").to_pylist()
        order = sorted(range(len(x)), key=lambda i: (ids[i], x[i].tobytes()))
        return pa.table({"dim": rows.column("dim")[:1], "tree": pa.array([pickle.dumps(Tree(prepare(x[order]), leaf=leaf))], pa.binary())})

    return {r.dim: pickle.loads(r.tree) for r in sample.groupBy("dim").applyInArrow(fit, "dim int, tree binary").collect()}


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their vectors as a matrix) for each length in a batch (id, dim, vector, ..)."""
    dims = batch.column(1).to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, V.rows_of(batch.column(2).take(pa.array(at)))


class Forest:
    """A tree for each length of vectors; a length that the sample lacks has one leaf, number 0. widths: leaves to visit."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees, self.widths = trees, {}

    def leaf_of(self, dim: int, x: np.ndarray) -> np.ndarray:
        return self.trees[dim].leaf_of(unit(x)) if dim in self.trees else np.zeros(len(x), np.int64)

    def visits(self, dim: int, v: np.ndarray) -> Iterator[int]:
        return self.trees[dim].visits(v) if dim in self.trees else iter([0])


def nearest(df: DataFrame, k: int = 5, query_step: int = 50, target: float = TARGET, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query, by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_step``; a query's own id is no candidate. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of every length are
    indexed, and a query meets those of its own length. A query that finds fewer than k ids in the leaves it visits goes
    on to all others. Ties go to the smaller id; rows that repeat an id are one query and one candidate, which have the
    best score of any two of their rows; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = V.usable(df, id_column, vector).where(F.exists("vector", lambda x: x != 0)).select("id", "dim", "vector")
    is_query = F.col("id") % query_step == 0
    n, queries, widest = rows.agg(F.count("*"), F.count_if(is_query), F.max("dim")).first()
    if not n:
        return V.ranked(spark.createDataFrame([], OUT), k)
    by_hash = lambda share, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    forest = Forest(fit_forest(rows, n, widest, unit))
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.zeros(b.num_rows, np.int32)
            for d, at, x in by_dim(b):
                leaf[at] = shared.value.leaf_of(d, x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["id", "dim", "vector", "uid", "leaf"])

    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    index = stage(numbered.mapInArrow(place, "id long, dim int, vector array<double>, uid long, leaf int"), "ann-index")

    # Calibration: true neighbours of some queries, and when best-bin-first search would come to their leaves.
    drawn = index.where(is_query & by_hash(CALIBRATION / max(queries, 1), "width")).select("id", "dim", "vector").limit(4 * CALIBRATION).toPandas().sort_values("id")
    asked = {int(d): (g["id"].to_numpy(np.int64), np.array(g["vector"].tolist(), float)) for d, g in drawn.groupby("dim")}
    known = spark.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dim(b):
                if d in known.value:
                    q_ids, q = known.value[d]
                    ids, leaf = b.column(0).to_numpy()[at], b.column(4).to_numpy()[at]
                    order = np.argsort(ids, kind="stable")
                    ids, leaf = ids[order], leaf[order]
                    r, c, s = _nearest(q_ids, q, ids, x[order], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids[c]), pa.array(s), pa.array(leaf[c])], ["query_id", "vec_id", "score", "leaf"])

    true: dict[int, list[int]] = {}
    if asked:
        for r in V.ranked(index.mapInArrow(compare, OUT + ", leaf int").withColumn("vec_id", F.struct("vec_id", "leaf")), k).select("query_id", "vec_id.leaf").collect():
            true.setdefault(r[0], []).append(r[1])
    for d, (q_ids, q) in asked.items():
        turns = []
        for i, v in zip(q_ids, unit(q), strict=True):
            turn = {leaf: t for t, leaf in enumerate(forest.visits(d, v), 1)}
            turns += [turn[leaf] for leaf in true.get(int(i), [])]
        turns.sort()
        if turns:
            # The fewest visits that reach the target, widened by a tenth. A length without calibration visits all.
            forest.widths[d] = int(np.ceil(1.1 * turns[min(len(turns) - 1, int(np.ceil(target * len(turns))))]))
    shared = spark.sparkContext.broadcast(forest)

    deal = lambda parts: F.pmod(F.xxhash64("uid"), parts).cast("int")
    parts = V.parts_of(index, "dim", "leaf")
    data = stage(V.packed(index.join(parts, ["dim", "leaf"]).withColumn("part", deal(F.col("parts"))), "dim", "leaf", "part"), "ann-blocks")

    def search(asking: DataFrame, everywhere: bool) -> DataFrame:
        """The k best of each row of ``asking`` (a part of the index) in the leaves that it visits."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows_at, leaves = [], []
                for d, at, x in by_dim(b):
                    width = (1 << 60) if everywhere else shared.value.widths.get(d, 1 << 60)
                    for i, v in zip(at.tolist(), unit(x), strict=True):
                        mine = list(islice(shared.value.visits(d, v), width))
                        rows_at += [i] * len(mine)
                        leaves += mine
                where = pa.array(rows_at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(3).take(where), b.column(1).take(where), pa.array(leaves, pa.int32())], ["uid", "dim", "leaf"])

        visits = asking.select("id", "dim", "vector", "uid").mapInArrow(go, "uid long, dim int, leaf int")
        visits = stage(visits.join(parts.select("dim", "leaf"), ["dim", "leaf"], "left_semi"), "ann-visits")
        # Blocks of queries are counted by the visits of a leaf, so a leaf's rows are sent once for each BLOCK of them.
        dealt = visits.join(V.parts_of(visits, "dim", "leaf", name="asks"), ["dim", "leaf"]).withColumn("asks", deal(F.col("asks")))
        asked_blocks = stage(V.packed(dealt.join(asking.select("uid", "id", "vector"), "uid"), "dim", "leaf", "asks"), "ann-queries")
        meeting = data.select("dim", "leaf", "part").join(asked_blocks.select("dim", "leaf", "asks"), ["dim", "leaf"])
        keys = ["dim", "leaf", "part", "asks"]
        theirs = asked_blocks.join(data.select("dim", "leaf", "part"), ["dim", "leaf"])
        mine, theirs = (t.select(*[F.col(c).alias(c) for c in (*keys, "ids", "vectors")]) for t in (data.join(meeting, ["dim", "leaf", "part"]), theirs))

        def meet(block: pa.Table, ask: pa.Table) -> pa.Table:
            if not block.num_rows or not ask.num_rows:
                return V.batches_of([], [], [], pa.float64())
            ids, x = V.unpack(block.column("ids")[0].as_py(), block.column("vectors")[0].as_py())
            q_ids, q = V.unpack(ask.column("ids")[0].as_py(), ask.column("vectors")[0].as_py())
            r, c, s = _nearest(q_ids, q, ids, x, k)
            return V.batches_of(q_ids[r], ids[c], s, pa.float64())

        return stage(V.ranked(mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, OUT), k), "ann-found")

    asking = index.where(is_query)
    found = search(asking, False)
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(asking.join(full, "id", "left_anti"), "ann-short")
    if not short.count():
        return found
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*found.columns).union(search(short, True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
