"""Work that grows with the tables stays spread over tasks, bounded in one, and right."""

from pyspark.sql import functions as F

from tilewright.operators import masks
from tilewright.sources import raw_slide
from tilewright.streaming import limits


def test_many_slides_share_partitions(spark, tmp_path, monkeypatch):
    for k in range(40):
        raw_slide.write_raw(f"{tmp_path}/s{k}.raw", 40, 32, bytes([k]) * (4 * 40 * 32))
    raw_slide.register(spark)
    df = spark.read.format("raw_slide").option("tile", "20").load(str(tmp_path))
    expected = sorted((f"s{k}", x, y) for k in range(40) for x in range(2) for y in range(2))
    assert sorted((r.slide, r.x, r.y) for r in df.collect()) == expected and df.rdd.getNumPartitions() == 1
    # Headers of many small slides are left to tasks; filters hold there too.
    monkeypatch.setattr(raw_slide, "FEW", 10)
    monkeypatch.setattr(raw_slide, "PACK", 8 * (raw_slide.OPEN + 8 + 4 * 40 * 32))
    monkeypatch.setattr(raw_slide._Reader, "_bands", lambda *a: 1 / 0)
    assert [len(p.parts) for p in raw_slide._Reader(str(tmp_path), 20).partitions()] == [8] * 5
    monkeypatch.undo()
    monkeypatch.setattr(raw_slide, "FEW", 10)
    reader = raw_slide._Reader(str(tmp_path), 20)
    reader.span["y"][0] = 1
    assert sorted((r[5], r[0], r[1]) for p in reader.partitions() for r in reader.read(p)) == [e for e in expected if e[2] == 1]


def test_frames_that_took_no_time(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (1, 3, 3.0), (2, 1, None)], "k int, t int, ms double")
    got = {(r.k, r.t): r.fps for r in limits.rolling_rate(df, "k", "t", "ms").collect()}
    assert got == {(1, 1): float("inf"), (1, 2): float("inf"), (1, 3): 1000.0, (2, 1): None}


def test_masks_are_packed_a_few_at_a_time(spark, monkeypatch):
    import random

    rng = random.Random(5)
    for step in (1 << 24, 40):
        monkeypatch.setattr(masks, "STEP_PIXELS", step)
        for n in (16, 5, 9):
            rasters = [None, [], *[[[rng.random() < 0.5 for _ in range(n)] for _ in range(rng.randrange(9))] for _ in range(30)], None]
            df = spark.createDataFrame([(i, r) for i, r in enumerate(rasters)], "i int, r array<array<boolean>>").coalesce(1)
            one = df.select("i", masks.packed(F.col("r")).alias("d")).cache()
            by_hand = {i: None if r is None else b"".join(sum(v << k for k, v in enumerate(row)).to_bytes(-(-n // 8), "little") for row in r) for i, r in enumerate(rasters)}
            assert {r.i: r.d for r in one.collect()} == by_hand
            assert {r.i: r.r for r in one.select("i", masks.unpacked(F.col("d"), F.lit(n)).alias("r")).collect()} == dict(enumerate(rasters))
            assert {r.i: r.r for r in df.select("i", masks.packed(masks.unpacked(masks.packed(F.col("r")), F.lit(n))).alias("r")).collect()} == by_hand
            one.unpersist()


def test_a_mask_costs_no_python_object_for_each_pixel(spark):
    import tracemalloc

    import pyarrow as pa

    made = []
    kept, masks.arrow_udf = masks.arrow_udf, lambda kind: lambda f: made.append(f) or (lambda *a: None)
    try:
        masks.unpacked(None, None), masks.packed(None)
    finally:
        masks.arrow_udf = kept
    data = pa.array([bytes(range(256)) * 400] * 40)  # 33 million pixels
    tracemalloc.start()
    back = made[1](made[0](data, pa.array([16] * 40)))
    assert back.equals(data) and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_brushes_are_painted_by_words(spark):
    import random

    rng = random.Random(2)
    strokes = [(rng.randrange(6), rng.randrange(-20, 1100), rng.choice([0, 3, 511, 512, 700]), rng.randrange(0, 40)) for _ in range(60)]
    expected = {(i, cx + dx, cy + dy) for i, cx, cy, r in strokes for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r and cx + dx >= 0 and cy + dy >= 0}
    df = spark.createDataFrame(strokes, "id long, cx int, cy int, radius int")
    pixels = [(r.id, r.patch_x * 512 + r.x, r.patch_y * 512 + r.y) for r in masks.brush(df).collect()]
    assert len(pixels) == len(set(pixels)) and set(pixels) == expected
    # A row of pixels is a few words, not as many rows of the table.
    words = masks.brush_words(df)
    assert words.agg(F.sum(F.bit_count("word"))).first()[0] == len(expected) and words.count() < len(expected) / 8
    assert masks.patches(words).select(masks.popcount(F.col("data")).alias("n")).agg(F.sum("n")).first()[0] == len(expected)
    assert sorted(map(str, masks.patches(words).collect())) == sorted(map(str, masks.painted(masks.brush(df)).collect()))


def test_a_small_file_is_spread(spark):
    from tilewright.session import spread

    df = spark.range(5000).coalesce(1)
    assert spread(df, 100).rdd.getNumPartitions() == 50 and spread(df).rdd.getNumPartitions() == 4 and spread(df.limit(10)).rdd.getNumPartitions() == 1
    strokes = df.select("id", F.lit(9).alias("cx"), F.lit(9).alias("cy"), F.lit(2).alias("radius"))
    assert "RoundRobinPartitioning(4)" in masks.brush_words(strokes)._jdf.queryExecution().toString()


def test_tiles_are_worked_on_together(spark, monkeypatch):
    import numpy as np

    from tilewright.operators import stain

    rng = np.random.default_rng(3)
    tiles = [rng.integers(0, 256, (5, 6, 4)).astype(np.uint8) for _ in range(20)]
    df = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(tiles)] + [(20, None)], "i int, pixels binary").coalesce(1)
    amount = 0.3 * 50 / 100
    by_one = {i: stain.sharpen(stain.resize(t[..., [2, 1, 0, 3]], 4, 7), amount, "clamp", 2.0).tobytes() for i, t in enumerate(tiles)} | {20: None}
    calls = []
    monkeypatch.setattr(stain, "STEP_PIXELS", 100)
    got = stain.processed(df, 6, 5, 50.0, True, (4, 7), True, name="out").select("i", "out").collect()
    assert {r.i: r.out for r in got} == by_one
    # One call of resize for many tiles.
    kept, stain.pandas_udf = stain.pandas_udf, lambda kind: lambda f: calls.append(f) or (lambda c: F.col(c))
    monkeypatch.setattr(stain, "resize", lambda p, *to: calls.append(p.shape) or p)
    monkeypatch.setattr(stain, "STEP_PIXELS", 300)
    try:
        stain.processed(df, 6, 5, to=(4, 7))
    finally:
        stain.pandas_udf = kept
    import pandas as pd

    calls[0](pd.Series([t.tobytes() for t in tiles]))
    assert calls[1:] == [(10, 5, 6, 4)] * 2


def test_queries_on_parts_are_dealt_over_tasks(spark):
    from tilewright.plans import view_queries

    for q in (view_queries.stroke_points, view_queries.sharpen_tiles, view_queries.swapped_tiles, view_queries.resized_tiles):
        plan = q(spark, "/root/testdata/sf0.1")._jdf.queryExecution().toString()
        assert "RoundRobinPartitioning" in plan and "Join" not in plan


def test_no_tiles_are_broadcast(spark):
    from tilewright.plans import pyramid_queries, view_queries

    # Tables of tiles look as small to Spark as what they are made of.
    for q in (pyramid_queries.empty_propagation, pyramid_queries.best_ancestor, view_queries.prefetch_tiles, view_queries.ancestor_part, pyramid_queries.viewport_topk, pyramid_queries.viewport_minus_sent):
        plan = q(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan, q
        # Views meet their images by broadcast at most; every join below a tile's columns is a merge.
        for line in plan.split("\n"):
            assert "BroadcastHashJoin" not in line or ("level" not in line and " x#" not in line and "_l#" not in line), (q, line)


def test_a_ring_of_tiles_around_the_view(spark):
    from tilewright.operators import viewport

    view = [(1, 1000.0, 1000.0, 900.0, 600.0, 1.0, 96.0, 9000, 7000, 5), (2, -50.0, 6000.0, 900.0, 600.0, 0.5, 96.0, 9000, 7000, 5)]
    v = spark.createDataFrame(view, "view_id int, view_x double, view_y double, view_width double, view_height double, zoom double, dpi double, width int, height int, levels int")
    every = spark.range(18).select(F.col("id").cast("int").alias("x")).crossJoin(spark.range(14).select(F.col("id").cast("int").alias("y"))).crossJoin(v.select("view_id")).withColumn("level", F.lit(0))
    got = viewport.prefetch_ring(v, F.lit(0), every.union(every).select("view_id", "level", "x", "y"), 2, 99)
    seen = {1: (range(1, 4), range(1, 4)), 2: (range(0, 4), range(11, 14))}
    wide = {1: (range(0, 6), range(0, 6)), 2: (range(0, 6), range(9, 14))}
    expected = {(i, x, y) for i in (1, 2) for x in wide[i][0] for y in wide[i][1] if not (x in seen[i][0] and y in seen[i][1])}
    rows = [(r.view_id, r.x, r.y) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
