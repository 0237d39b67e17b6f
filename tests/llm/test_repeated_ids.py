"""Vector searches of tables whose ids repeat, and how often blocks of vectors are sent."""

import numpy as np
import pytest

from tests.compare import duck_rows, spark_rows
from tilewright.llm import ann, topk
from tilewright.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>"


def rows_with_repeats(n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dim)).astype(np.float32))]
    rows += [(50, rng.normal(size=dim).astype(np.float32).tolist()) for _ in range(150)]  # a query with many vectors
    rows += [(7, rows[7][1])] * 40 + [(9, (np.array(rows[50][1]) * (1 + k / 100)).tolist()) for k in range(30)]  # candidates that repeat
    return rows + [rows[100]] * 3


def best(rows, measure, k=5):
    """The k best ids of each query id over all its rows, each id once."""
    ids = np.array([i for i, _ in rows])
    score = measure(np.array([v for _, v in rows], float))
    out = {}
    for q in np.unique(ids[ids % 50 == 0]):
        top = {}
        for s, c in zip(score[ids == q].max(0), ids, strict=True):
            if c != q:
                top[int(c)] = max(top.get(int(c), s), s)
        out[int(q)] = sorted(top.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def test_top_k_of_repeated_ids(spark, monkeypatch):
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def products(x):
        x = np.floor(256 * x).astype(np.int64)
        return x @ x.T

    expected = [(q, r, i, int(s)) for q, top in best(rows, products).items() for r, (i, s) in enumerate(top, 1)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)
    assert spark_rows(topk.top_k(df))[1] == duck_rows(topk.SQL, embeddings=df.toPandas())[1]
    monkeypatch.setattr(V, "BLOCK", 16)
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)


@pytest.mark.parametrize("block", [16, 1024])
def test_nearest_of_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def cosines(x):
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return x @ x.T

    expected = best(rows, cosines)
    got = {}
    for r in ann.nearest(df, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert {q: sorted(v) for q, v in got.items()} == {q: [(r, i, round(float(s), 9)) for r, (i, s) in enumerate(top, 1)] for q, top in expected.items()}


def test_a_query_whose_leaf_holds_its_own_rows_only_goes_on(spark, monkeypatch):
    """Two hundred rows of one query id stand together, far from all else."""
    rng = np.random.default_rng(1)
    near = [(50, (np.array([100.0] + [0.0] * 7) + 0.01 * rng.normal(size=8)).tolist()) for _ in range(200)]
    rows = near + [(1000 + i, np.append(-abs(rng.normal()), rng.normal(size=7)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ann, "LEAF", 16)
    got = [r.vec_id for r in ann.nearest(df, target=0.5).where("query_id = 50").collect()]
    assert len(got) == len(set(got)) == 5


def test_blocks_are_sent_in_proportion(spark, monkeypatch):
    """A leaf or group of shards has no more blocks of queries than one, and one for each BLOCK of its visits."""
    monkeypatch.setattr(V, "BLOCK", 32)
    for module, name in ((ann, "ann-queries"), (topk, "topk-away")):
        for n in (1500, 3000):
            rng = np.random.default_rng(2)
            df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))], SCHEMA)
            staged = {}
            monkeypatch.setattr(module, "stage", lambda t, as_name, real=__import__("tilewright.session", fromlist=["stage"]).stage, into=staged: into.setdefault(as_name, real(t, as_name)))
            (ann.nearest if module is ann else topk.top_k)(df, query_step=5).count()
            t = staged[name]
            keys = ["dim", "leaf", "asks"] if module is ann else ["dim", "cell", "group", "asks"]
            blocks, visits = t.select(*keys).distinct().count(), staged["ann-visits" if module is ann else "topk-visits"].count()
            groups = t.select(*keys[:-1]).distinct().count()
            assert blocks <= groups + visits / 32


def test_rows_of_an_id_that_reach_the_curve_are_bounded(spark, monkeypatch):
    """Each toxic id has a hundred texts of its own; the curve is fitted on a few of each."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tilewright.llm import toxicity

    docs = spark.range(40_000).select((F.col("id") % 400).alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, "vile ").otherwise("kind "), F.lit("words stand here "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    fitted = []
    monkeypatch.setattr(toxicity, "curve", lambda values, labels: fitted.append(pd.DataFrame({"v": values, "y": labels})) or (1.0, 0.0))
    toxicity.train(docs, labels)
    assert 0 < len(fitted[0]) <= 400 * toxicity.TEXTS and fitted[0]["y"].nunique() == 2
