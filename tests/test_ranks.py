"""Places in a key's order, with cells of a few rows, against plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from tilewright.operators import ranks, stain, viewport
from tilewright.plans import registry

SCHEMA = "k string, a double, b long, size long"


def rows(seed, n):
    rng = random.Random(seed)
    out = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([rng.uniform(-5, 5), rng.gauss(0, 1e6), 1.0, None, math.nan]), rng.randrange(40), rng.choice([None, rng.randrange(9)])) for _ in range(n)]
    return out + [("hot", 2.0, i, 1) for i in range(300)] + [("ends", math.inf if i % 2 else -math.inf, i, 1) for i in range(100)] + [("one", 1.0, 1, 1)]


def key(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_places_equal_sorting(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ranks, "CELL_ROWS", 16)
    monkeypatch.setattr(ranks, "CUTS", 4)
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", broadcast)
    data = rows(1, 600)
    df = spark.createDataFrame(data, SCHEMA)
    got = ranks.numbered(df, ["k"], ["a", "b"], "nth", running=("size", "sum")).collect()
    assert len(got) == len(data)
    for k in {r[0] for r in data}:
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(1, len(mine) + 1))
        assert [(key(r.a), r.b) for r in mine] == sorted((key(a), b) for c, a, b, _ in data if c == k)
        total = 0
        for r in mine:
            assert r.sum == total
            total += r.size or 0
    few = ranks.numbered(df, ["k"], ["a", "b"], "nth", upto=20).collect()
    assert sorted((str(r.k), r.nth, str(r.a), r.b) for r in few) == sorted((str(r.k), r.nth, str(r.a), r.b) for r in got if r.nth <= 20) or all(r.nth <= 20 for r in few)
    assert ranks.numbered(df.limit(0), ["k"], ["a"], "nth").count() == 0


def test_one_view_with_all_entries_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 500)
    df = spark.range(20_000).select(F.lit(0).alias("view"), "id", (F.col("id") * 7919 % 10_007).alias("at"))
    kept = viewport.prune(df, "view", "at", hard=True)
    times = sorted(r.at for r in df.collect())
    assert sorted(r.at for r in kept.collect()) == [t for t in times if t >= times[20_000 - viewport.SOFT]]
    assert "SinglePartition" not in kept._jdf.queryExecution().executedPlan().toString()
    soft = viewport.prune(df, "view", "at", hard=False)
    assert sorted(r.at for r in soft.collect()) == [t for t in times if t >= times[viewport.BATCH]]


def test_a_percentile_outside_its_band_is_found(spark, monkeypatch):
    """The band is put in the wrong place on purpose: too high, too low and right."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"))
    values = {k: sorted(float(i) for i in range(k, 3000, 3) if i % 10) for k in range(3)}
    expected = {k: v[min(int(len(v) * 0.5), len(v) - 1)] for k, v in values.items()}
    real = F.percentile_approx
    for shift in (0, 700, -700):
        monkeypatch.setattr(stain.F, "percentile_approx", lambda c, p, a, s=shift: F.transform(real(c, p, a), lambda x: x + s))
        got = {r.k: r.p for r in stain.floor_percentile(df, "k", "v", 0.5, "p").collect()}
        monkeypatch.undo()
        assert got == expected, shift


def test_percentiles_of_users_with_many_events_equal_the_sql(spark, tmp_path):
    """From 101 events on the nearest place is not always the one below; 150 and 250 stand at halves."""
    counts = (1, 50, 99, 100, 101, 120, 149, 150, 151, 250, 350, 1049)
    df = spark.createDataFrame([(u, float(i * 7919 % 10_007)) for u, n in enumerate(counts) for i in range(n)], "user_id long, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet").toPandas()
    assert spark_rows(registry.QUERIES["pct_floor"](spark, str(tmp_path))) == duck_rows(registry.ORACLE["pct_floor"], events=events)
