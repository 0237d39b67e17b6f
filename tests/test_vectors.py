"""Known inputs and results of the operators, as listed in FIXTURES.md, and streams held against their batch forms."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from tilewright.functions import packets, text
from tilewright.operators import catalog, geometry, masks, placement, pyramid, stain, viewport
from tilewright.sources import objects, raw_slide
from tilewright.streaming import limits, views


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# --- masks


def test_stride_and_size(spark):
    assert one(spark, *[masks.stride(F.lit(w)) for w in (1, 7, 8, 9, 16, 17)]) == (1, 1, 1, 2, 2, 3)
    assert one(spark, *[masks.expected_size(F.lit(a), F.lit(b)) for a, b in ((8, 8), (10, 10), (512, 512))]) == (8, 20, 32768)


def test_pixels_set_and_read(spark):
    df = spark.range(1).select(F.unhex(F.lit("00" * 32)).alias("d"))
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (7, 0), (8, 0), (15, 15), (-1, 3), (16, 2))])
    df = df.select(masks.with_pixels(F.col("d"), F.lit(16), points, F.lit(True)).alias("d"))
    at = lambda x, y: masks.get_pixel(F.col("d"), F.lit(16), F.lit(16), F.lit(x), F.lit(y)).alias(f"p{x}_{y}".replace("-", "m"))
    got = df.select(*[at(x, y) for x, y in ((0, 0), (7, 0), (8, 0), (15, 15), (1, 0), (0, 1), (-1, 0), (16, 0), (0, 16))], masks.popcount(F.col("d")).alias("n")).first()
    assert tuple(got) == (True,) * 4 + (False,) * 5 + (4,)


def test_pack_and_unpack(spark):
    raster = [[True, False, True, False], [False, True, False, True]]
    df = spark.createDataFrame([(raster,)], "r array<array<boolean>>").select(masks.packed(F.col("r")).alias("d"))
    assert df.select(masks.unpacked(F.col("d"), F.lit(4)).alias("r")).first()[0] == raster


def test_base64_needs_the_exact_length(spark):
    good = F.base64(F.unhex(F.lit("0102030405060708")))
    bad = F.base64(F.unhex(F.lit("01020304050607")))
    assert one(spark, masks.decoded(good, F.lit(8), F.lit(8)), masks.decoded(bad, F.lit(8), F.lit(8))) == (bytearray(range(1, 9)), None)


def test_brush_covers_the_disc(spark):
    df = spark.createDataFrame([(1, 511, 100, 3)], "id int, cx int, cy int, radius int")
    pixels = {(r.patch_x * 512 + r.x, r.y) for r in masks.brush(df).collect()}
    assert pixels == {(511 + a, 100 + b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9}


# --- pyramid and viewport


def test_levels_and_keys(spark):
    assert one(spark, *[pyramid.max_level(F.lit(n), F.lit(n)) for n in (512, 1024, 2048, 100_000)]) == (0, 1, 2, 8)
    assert one(spark, pyramid.pack_key(F.lit(5), F.lit(7), F.lit(3))) == (3298542223365,)
    assert one(spark, *pyramid.unpack_key(F.lit(3298542223365)).values()) == (5, 7, 3)


def test_empty_tiles_hide_finer_ones(spark):
    tiles = spark.createDataFrame([(1, lv, x, y, 2) for lv in range(3) for x in range(4 >> lv) for y in range(4 >> lv)], "id int, level int, x int, y int, max_level int")
    empty = spark.createDataFrame([(1, 1, 0, 0)], "id int, level int, x int, y int")
    left = {(r.level, r.x, r.y) for r in pyramid.without_empty(tiles, empty, "id").collect()}
    assert left == {(0, x, y) for x in range(4) for y in range(4) if x > 1 or y > 1} | {(1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)}


def test_ideal_level_rounds_halves_up(spark):
    got = one(spark, *[viewport.ideal_level(F.lit(z), F.lit(96.0), F.lit(5)) for z in (2.0, 1.0, 0.5, 0.25, 2**-1.5, 0.001)])
    assert got == (0, 0, 1, 2, 2, 4)


# --- geometry


def test_ellipse_box_is_tight(spark):
    b = geometry.ellipse_bounds(F.lit(10.0), F.lit(20.0), F.lit(4.0), F.lit(2.0), F.lit(math.pi / 2))
    x0, y0, x1, y1 = one(spark, *[b[k] for k in ("x_min", "y_min", "x_max", "y_max")])
    assert (x0, y0, x1, y1) == pytest.approx((8, 16, 12, 24))


def test_point_in_polygon(spark):
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    line = F.array(*[F.array(F.lit(float(x)), F.lit(0.0)) for x in (0, 4)])
    assert one(spark, *[geometry.point_in_polygon(F.lit(x), F.lit(y), p) for x, y, p in ((2.0, 2.0, square), (5.0, 2.0, square), (2.0, 0.0, line))]) == (True, False, False)


def test_simplified_keeps_corners(spark):
    path = [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 2.0]]
    df = spark.createDataFrame([(path,)], "p array<array<double>>")
    assert df.select(geometry.simplified(F.col("p"), 0.1)).first()[0] == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]


# --- placement


def replicas(spark, rows):
    return spark.createDataFrame(rows, "shard_id int, name string, role string, ready boolean, last_heartbeat long, lag long")


def failover(spark, rows, epoch, cooldown=False):
    epochs = spark.createDataFrame([(0, epoch, cooldown)], "shard_id int, epoch long, cooldown boolean")
    return [tuple(r) for r in placement.failover(replicas(spark, rows), epochs, 100_000, 10_000).collect()]


def test_failover(spark):
    now = 100_000
    stale, spare = (0, "m", "master", False, now - 20_000, None), [(0, "r1", "replica", True, now - 1000, 50), (0, "r2", "replica", True, now - 1000, 10)]
    assert failover(spark, [stale, *spare], 3) == [(0, "r2", ["m"], 4)]
    assert failover(spark, [(0, "m", "master", True, now - 100, None), *spare], 3) == []
    assert failover(spark, [stale, *spare], 3, True) == []
    assert failover(spark, [(0, "old", "master", True, now - 20_000, None), (0, "new", "replica", True, now - 100, 2)], 9) == [(0, "new", ["old"], 10)]
    best = placement.best_replica(replicas(spark, [(0, "stale", "replica", True, now - 40_000, 0), (0, "fresh", "replica", True, now - 100, 20)]), now, 10_000)
    assert best.first()["promote"] == "fresh"


def test_slots_and_epochs(spark):
    crc = one(spark, placement.crc16(F.lit("123456789").cast("binary")), placement.slot(F.unhex(F.lit("2a" * 16)), F.lit(1), F.lit(2), F.lit(3)))
    assert crc == (0x31C3, 11751)
    assert [r.shard for r in placement.slot_table(spark, 4, 16).orderBy("slot").collect()] == [k // 4 for k in range(16)]
    assert one(spark, *[placement.next_epoch(*map(F.lit, a)) for a in ((0, 0, 3), (5, 3, 3), (5, 3, 4))]) == (1, 5, 6)


def test_config_epochs_only_rise(spark):
    df = spark.createDataFrame([(0, 2, 0), (0, 2, 1), (0, 1, 2)], "shard_id int, config_epoch long, seq int")
    assert [r.accepted for r in placement.installed(df).orderBy("seq").collect()] == [True, False, False]


def test_topology_difference(spark):
    clusters = spark.createDataFrame([("c", 2, 2)], "cluster string, shards int, replicas int")
    existing = spark.createDataFrame([("c-s0-r0",), ("c-s0-r1",), ("c-s9-r9",)], "pod string")
    got = {tuple(r) for r in catalog.difference(placement.desired_pods(clusters).select("pod"), existing, "pod").collect()}
    assert got == {("c-s1-r0", "create"), ("c-s1-r1", "create"), ("c-s9-r9", "delete")}


# --- text and packets


def test_uuid5(spark):
    assert one(spark, text.uuid5(F.lit("ds:key"))) == (str(uuid.uuid5(uuid.NAMESPACE_DNS, "x")) and "b7241721-67fc-507a-b6ce-620dfe526e41",)


@pytest.mark.parametrize("value,digits,expected", [(0.15, 1, "0.1"), (0.25, 1, "0.3"), (0.35, 1, "0.3"), (1.65, 1, "1.6"), (2.5, 0, "3"), (1.005, 2, "1.00"), (303.95, 1, "303.9"), (9.99, 1, "10.0"), (0.0, 2, "0.00"), (1234567.125, 2, "1234567.13")])
def test_fixed_decimals_by_exact_value(spark, value, digits, expected):
    assert one(spark, text.fixed(F.lit(value), digits)) == (expected,)


def test_float32_of_a_packet(spark):
    import struct

    df = spark.createDataFrame([(struct.pack("<ffIIf", 1.5, -2.25, 800, 600, 0.1),)], "d binary")
    v = packets.viewport(F.col("d"))
    got = df.select(*[c.alias(k) for k, c in v.items()]).first()
    assert tuple(got) == pytest.approx((1.5, -2.25, 800, 600, struct.unpack("<f", struct.pack("<f", 0.1))[0]))


def test_variants_merge_like_plain_objects(spark):
    import json
    import random

    rng = random.Random(2)

    def thing(depth):
        kind = rng.randrange(6 if depth else 4)
        return rng.choice([1, "s", None, True, -5]) if kind < 3 else [rng.randrange(3)] if kind == 3 else {rng.choice("abcd"): thing(depth - 1) for _ in range(3)}

    def deep(x, y):
        return {**x, **{k: deep(x[k], v) if k in x else v for k, v in y.items()}} if isinstance(x, dict) and isinstance(y, dict) else y

    pairs = [({k: thing(4) for k in "abc"}, {k: thing(4) for k in "bcd"}) for _ in range(60)] + [([1], {"a": 1}), ({"a": 1}, 3), (2, {"a": {}})]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(100, None, "[1]"), (101, '{"a": 1}', None)], "i int, a string, b string")
    out = df.select("i", F.to_json(text.deep_merged(F.parse_json("a"), F.parse_json("b"))).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: json.loads(r.m) for r in out.collect()}
    assert got == {i: deep(a, b) for i, (a, b) in enumerate(pairs)} | {100: [1], 101: {"a": 1}}


# --- sources


def test_raw_slide(spark, tmp_path):
    pixels = bytes(range(256)) * 4 * 3  # 32 by 24
    raw_slide.write_raw(str(tmp_path / "a.raw"), 32, 24, pixels)
    raw_slide.register(spark)
    rows = spark.read.format("raw_slide").option("tile", "16").load(str(tmp_path / "a.raw")).collect()
    assert {(r.x, r.y, r.width, r.height) for r in rows} == {(x, y, 16, 16 if y == 0 else 8) for x in (0, 1) for y in (0, 1)}
    joined = bytearray(len(pixels))
    for r in rows:
        for k in range(r.height):
            at = 4 * ((r.y * 16 + k) * 32 + r.x * 16)
            joined[at : at + 64] = r.pixels[64 * k : 64 * k + 64]
    assert bytes(joined) == pixels


def test_a_region_reads_its_own_bytes(spark, tmp_path):
    import numpy as np
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    rng = np.random.default_rng(1)
    pixels = {s: rng.integers(0, 256, (50, 70, 4)).astype(np.uint8) for s in ("a", "b", "c")}
    for s, p in pixels.items():
        raw_slide.write_raw(f"{tmp_path}/{s}.raw", 70, 50, p.tobytes())
    raw_slide.register(spark)
    df = spark.read.format("raw_slide").option("tile", "16").option("path", f"file://{tmp_path}").load()
    assert df.count() == 3 * 5 * 4
    rows = df.where("slide in ('a', 'c') and y > 1 and y <= 2 and x in (1, 2, 4) and width > 10").collect()
    assert {(r.slide, r.x, r.y, r.width, r.height) for r in rows} == {(s, x, 2, 16, 16) for s in ("a", "c") for x in (1, 2)}
    assert all(r.pixels == pixels[r.slide][32:48, 16 * r.x : 16 * r.x + r.width].tobytes() for r in rows)
    assert df.where("x = 9 or y < 0").count() == 0 and df.where("x = 1 and x = 2").count() == 0

    class Counted:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def read_at(self, n, at):
            self.bytes += n
            return self.f.read_at(n, at)

    reader = raw_slide._Reader(str(tmp_path), 16)
    left = list(reader.pushFilters([EqualTo(("slide",), "b"), GreaterThan(("y",), 0), LessThanOrEqual(("y",), 1), In(("x",), (1, 2)), StringContains(("slide",), "b")]))
    parts = reader.partitions()
    assert [type(f) for f in left] == [StringContains] and [(p.slide, p.y, p.x0, p.x1) for p in parts] == [("b", 1, 1, 3)]
    with open(parts[0].path, "rb") as f:
        assert len(f.read()) == 8 + 4 * 70 * 50
    counted, store = [], raw_slide.opened(str(tmp_path))[0]

    class Store:
        def open_input_file(self, path):
            from contextlib import contextmanager

            @contextmanager
            def go():
                with store.open_input_file(path) as f:
                    counted.append(Counted(f))
                    yield counted[-1]

            return go()

    before = raw_slide.opened
    raw_slide.opened = lambda path: (Store(), path)
    try:
        assert len(list(reader.read(parts[0]))) == 2
    finally:
        raw_slide.opened = before
    assert counted[0].bytes == 4 * 16 * 32


def test_listing_and_sidecars(spark, tmp_path):
    for name, content in (("a.SVS", b"x"), ("b.tiff", b"y"), ("c.txt", b"z"), ("a.SVS.json", b'{"stain": "HE"}'), ("b.tiff.json", b"{bad")):
        (tmp_path / name).write_bytes(content)
    files = objects.with_sidecars(objects.listing(spark, str(tmp_path)), str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.metadata) for r in files.collect()} == {("a.SVS", '{"stain": "HE"}'), ("b.tiff", None)}


# --- streams against their batch forms


def streamed(spark, df, path, transform):
    df.coalesce(1).write.parquet(str(path / "in"))
    name = f"t{uuid.uuid4().hex}"
    stream = spark.readStream.schema(df.schema).parquet(str(path / "in"))
    # One batch: with timeouts by processing time a query is never out of batches.
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(once=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, i * 700 + u) for u in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, id long, at long")
    args = ("user", "at", "id", 3, 2_500, 9, 7_000)
    batch = limits.rate_limited(df, *args).select("user", "id", "at", "burst_count", "long_count", "denied")
    stream = streamed(spark, df, tmp_path, lambda s: limits.rate_limit_stream(s, *args)).select(batch.columns)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_gate_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, (i * i * 137 + u * 11) % 9000) for u in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, id long, at long")
    batch = limits.gated(df, ["user"], "at", "id", 900).select("user", "id", "at", "passed")
    stream = streamed(spark, df, tmp_path, lambda s: limits.gate_stream(s, "user", "at", "id", 900)).select(batch.columns)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


# --- catalogue


def test_page_of_nothing_carries_no_count(spark):
    empty = spark.createDataFrame([], "id long, name string")
    assert catalog.page(empty, ["name", "id"], 10).count() == 0
    with pytest.raises(ValueError):
        catalog.page(empty, ["name"], 0)


def test_soft_delete_happens_once(spark):
    base = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, deleted_at long")
    gone = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in catalog.soft_delete(base, gone, "id", 9).select("id", "deleted_at").collect()} == {(1, 9), (2, 5), (3, None)}


# --- what follows formulas, by known values


def test_painted_patches(spark):
    import numpy as np

    pixels = masks.brush(spark.createDataFrame([(1, 511, 3, 2), (2, 0, 0, 1)], "id long, cx int, cy int, radius int"))
    got = {(r.id, r.patch_x, r.patch_y): np.unpackbits(np.frombuffer(r.data, np.uint8).reshape(512, 64), axis=1, bitorder="little") for r in masks.painted(pixels).collect()}
    expected = {}
    for i, cx, cy, radius in ((1, 511, 3, 2), (2, 0, 0, 1)):
        for dx in range(-radius, radius + 1):
            for dy in range(-radius, radius + 1):
                x, y = cx + dx, cy + dy
                if dx * dx + dy * dy <= radius * radius and x >= 0 and y >= 0:
                    expected.setdefault((i, x // 512, y // 512), np.zeros((512, 512), np.uint8))[y % 512, x % 512] = 1
    assert got.keys() == expected.keys() and all((got[k] == expected[k]).all() for k in got)


def test_factorisation_keeps_its_own_concentrations():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((400, 2)) * 2 @ np.array(stain.REFERENCE).T + rng.random((400, 3)) * 0.02
    w, h = stain.nmf(x)
    assert np.allclose(np.linalg.norm(w, axis=0), 1) and np.abs(h @ w.T - x).max() < 0.2
    m, most = stain.parameters(x, "vahadane")
    assert np.array_equal(m, w) and np.allclose(most, np.sort(h, axis=0)[int(400 * 0.99)])
    assert np.array_equal(stain.amounts(np.ones((1, 3)), np.ones((3, 2))), [[1.0, 1.0]])  # singular


def test_sharpening_modes():
    import numpy as np

    p = np.full((3, 3, 4), 200, np.uint8)
    p[1, 1, :3] = (250, 240, 230)
    first, second = stain.sharpen(p, 0.8), stain.sharpen(p, 0.3, "clamp", 2.0)
    y, e = 0.299 * 250 + 0.587 * 240 + 0.114 * 230, 200.0
    blur = (4 * y + 12 * e) / 16
    assert [*first[1, 1, :3]] == [min(255, round(v * min(255, y + 0.8 * (y - blur)) / y)) for v in (250, 240, 230)]
    assert [*second[1, 1, :3]] == [min(255, int(v * (y + 0.3 * (y - blur)) / y)) for v in (250, 240, 230)]
    black = np.zeros((3, 3, 4), np.uint8)
    black[0, 0] = 255
    assert (stain.sharpen(black, 0.3, "clamp", 2.0)[1, 1] == 0).all()


def test_part_of_an_ancestor_at_the_edge(spark):
    # An image of 1500 by 700: tile (2, 1) of level 0 ends at the edge, and so does its ancestor (0, 0) of level 2.
    part = viewport.source_part(F.lit(0), F.lit(2), F.lit(1), F.lit(2), F.lit(1500), F.lit(700), F.lit(375), F.lit(175))
    got = spark.range(1).select(*[v.alias(k) for k, v in part.items()]).first()
    assert (got.sx, got.sy, got.s_width, got.s_height) == pytest.approx((256.0, 128.0, (1500 - 1024) / 4, (700 - 512) / 4))


def test_settled_parameters_stay(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    samples = lambda: (rng.random((700, 2)) @ np.array(stain.REFERENCE).T + 0.05).tolist()
    df = spark.createDataFrame([("a", samples()) for _ in range(22)], "slide string, samples array<array<double>>")
    rows = streamed(spark, df, tmp_path, views.settling_parameters).collect()
    # 5000 samples and 8 tiles make an estimate; after three checks samples are let go.
    assert [(r.tiles, r.stable) for r in rows] == [(8, False), (12, False), (16, False), (20, True)]
    assert len({str(r.stain) for r in rows}) == 1 and len({str(r.most) for r in rows}) == 1


def test_tiles_of_a_trigger_are_taken_in_order(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [("a", n, (rng.random((700, 2)) @ np.array(stain.REFERENCE).T + 0.02 * n).tolist()) for n in range(14)]
    got = []
    for name, given in (("in", rows), ("back", rows[::-1])):
        df = spark.createDataFrame(given, "slide string, nth long, samples array<array<double>>").coalesce(1)
        (tmp_path / name).mkdir()
        out = streamed(spark, df, tmp_path / name, lambda t: views.settling_parameters(t, order="nth"))
        got.append([(r.tiles, str(r.stain), str(r.most), r.stable) for r in out.collect()])
    assert got[0] == got[1] and len(got[0]) > 1


def test_percentile_of_one_large_group(spark):
    df = spark.range(50_001).select(F.lit(1).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(5000))).cast("double").alias("v"))
    values = sorted(r.v for r in df.collect() if r.v is not None)
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        assert stain.floor_percentile(df, "k", "v", share, "p").first().p == values[min(int(len(values) * share), len(values) - 1)]


def test_files_of_tiles_and_results(spark, tmp_path):
    for name in ("s1/0/3_4.webp", "s1/2/0_1.webp", "s1/2/bad.webp", "s1/x/0_1.webp"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"x")
    assert {(r.id, r.level, r.x, r.y) for r in objects.tile_files(spark, str(tmp_path / "t")).collect()} == {("s1", 0, 3, 4), ("s1", 2, 0, 1)}
    objects.write_results(spark.createDataFrame([(1, True), (2, False)], "id long, accepted boolean"), str(tmp_path / "out"))
    read = lambda k: sorted(r.id for r in spark.read.json(str(tmp_path / "out" / k)).collect())
    assert (read("candidates"), read("accepted"), read("rejected")) == ([1, 2], [1], [2])


def test_a_consumer_takes_each_event_once(spark, tmp_path):
    seen = []
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        objects.consume(stream, lambda batch, _: seen.extend(r.id for r in batch.collect()), str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    assert sorted(seen) == [0, 1, 2, 3, 4]
