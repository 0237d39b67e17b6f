"""Live views as streams: several triggers, restarts, late rows and views that are forgotten."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.plans import session_queries
from tilewright.streaming import sessions, views
from tilewright.streaming.sessions import Limits, Tile, View

ACTIONS = "view long, kind string, at long, nth long, key long, wanted array<long>, ranges array<int>"
#: Times start here, for a stream takes the time 0 as late.
BASE = 1_000_000
#: A view of columns 0 to 3 of row 0 of level 2, and how tiles are numbered there.
SEEN = [2, 0, 4, 0, 1]


def tile(x, level=2):
    return x | level << 40


def act(kind, at, key=None, wanted=(), view=1, nth=0):
    return (view, kind, BASE + at, nth, key if key is None else tile(key), [tile(x) for x in wanted], SEEN if kind == "update" else [])


def run(spark, folder, transform, schema, batches, timed):
    """Each batch is a trigger of its own, and the query is started anew for each; rows that came out, and the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        with sessions.keyed_state(spark):
            q = transform(timed(stream)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
    return spark.read.parquet(f"{folder}/out"), f"{folder}/cp"


def timed(delay):
    return lambda stream: stream.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay)


ROWS = [
    act("update", 0, wanted=[0, 1]), act("made", 5, 0), act("made", 6, 2), act("made", 7, 9), act("request", 100, 2), act("request", 2006, 2),
    act("fetched", 2100, 2), act("fetched", 2101, 2), act("fetched", 2102, 3), act("update", 2500, wanted=[1, 3]), act("fetched", 2600, 0), act("request", 2601, 0),
    act("open", 3000), act("fetched", 3001, 3), act("update", 3002, wanted=[0]),
]
OUT = [
    ("send", 0, 0), ("send", 1, 0), ("send", 2, 6), ("send", 2, 2006), ("deliver", 2, 2100), ("send", 3, 2500), ("send", 0, 2601), ("send", 0, 3002),
]


@pytest.mark.parametrize("cuts", [[], [4, 9], list(range(1, 15))[::3]])
def test_sent_tiles_in_one_trigger_or_many(spark, tmp_path, cuts):
    batches = [ROWS[a:b] for a, b in zip([0, *cuts], [*cuts, len(ROWS)], strict=True)]
    # The view's own clock is events' time, so a long delay keeps timers out of this.
    out, cp = run(spark, str(tmp_path), sessions.sent_tiles, ACTIONS, batches, timed("1 hour"))
    got = sorted((r.at - BASE, r.turn, r.kind, r.key & 0xFFFFF) for r in out.collect())
    assert sorted((k, x, at) for at, _, k, x in got) == sorted(OUT)
    assert [tuple(r) for r in sessions.tiles_held(spark, cp).collect()] == [(1, tile(0), 1, BASE + 3002, False)]


def test_a_view_is_forgotten_by_its_timer_and_by_its_own_clock(spark, tmp_path):
    limits = Limits(forget=10_000)
    first = [act("update", 0, wanted=[0, 1]), act("update", 1000, wanted=[2], view=2)]
    # View 1 comes back late; view 2 stays away while view 3 moves time on.
    out, cp = run(spark, str(tmp_path), lambda s: sessions.sent_tiles(s, limits), ACTIONS, [first, [act("update", 9_000, wanted=[1, 3])], [act("update", 25_000, wanted=[0, 1]), act("update", 25_000, wanted=[7], view=3)]], timed("0 seconds"))
    got = sorted((r.view, r.at - BASE, r.key & 0xFFFFF) for r in out.collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 9000, 3), (1, 25000, 0), (1, 25000, 1), (2, 1000, 2), (3, 25000, 7)]
    assert sorted((r.view, r.key & 0xFFFFF) for r in sessions.tiles_held(spark, cp).collect()) == [(1, 0), (1, 1), (3, 7)]


def test_superseded_tiles_may_be_asked_for_again_and_old_ones_go():
    v = View(Limits(soft=3, hard=5, batch=2, most=4), {})
    assert v.update(100_000, [1, 2, 3, 4, 5, 6], []) == [1, 2, 3, 4]
    assert v.request(100_500, 1) == []  # asked for just now
    assert v.update(101_000, [1, 7], []) == [7]
    assert v.tiles[1] == Tile(1, 101_000 - 28_000, False, 1, 1)
    assert v.request(101_100, 1) == [1] and v.tiles[1] == Tile(2, 101_100, False, 2, 1)
    v.request(101_200, 8)
    assert len(v.tiles) == 6 and v.update(200_000, [], []) == []
    assert set(v.tiles) == {7, 1, 8}  # the three oldest went
    v.request(300_000, 9)
    v.tick()
    assert set(v.tiles) == {8, 9}


def test_the_replay_holds_all_kinds_of_rows(spark, sf_dir):
    rows = session_queries.sent_tile_state(spark, sf_dir).collect()
    assert any(r.delivered for r in rows) and any(r["count"] > 1 for r in rows)


# --- tile events of interest

EVENTS = "event_id long, slide long, at long, level int, x int, y int"
VIEWS = "view_id long, slide long, at long, view_x double, view_y double, view_width double, view_height double, zoom double, dpi double, width int, height int, levels int"


def events_and_views(seed, n):
    rng = random.Random(seed)
    events = [(i, rng.randrange(3), BASE + rng.randrange(100_000), rng.randrange(4), rng.randrange(4), rng.randrange(4)) for i in range(n)]
    looks = [(v, v % 3, BASE + rng.randrange(100_000), rng.uniform(0, 1500), rng.uniform(0, 1500), 800.0, 600.0, rng.choice([1.0, 0.5, 0.25]), 96.0, 2048, 2048, 4) for v in (rng.randrange(8) for _ in range(n // 5))]
    return sorted(events, key=lambda e: e[2]), sorted(looks, key=lambda v: v[2])


def plain(events, looks, hold):
    import math

    out = []
    for i, slide, at, level, x, y in events:
        for v in {u[0] for u in looks if u[1] == slide}:
            before = [u for u in looks if u[0] == v and u[1] == slide and u[2] <= at]
            if not before or at - before[-1][2] >= hold:
                continue
            _, _, _, vx, vy, w, h, zoom, _, width, height, levels = before[-1]
            step, ideal = 512 * 2**level, 0 if zoom >= 1 else math.floor(-math.log2(zoom) + 0.5)
            sees = lambda t, p, view, size: max(0, math.floor(p / step)) <= t < min(max(0, math.ceil((p + view / zoom) / step)), math.ceil(size / step))  # noqa: B023, E731
            if level >= max(0, min(max(0, ideal - 2), levels - 1)) and sees(x, vx, w, width) and sees(y, vy, h, height):
                out.append((v, i))
    return sorted(out)


@pytest.mark.parametrize("hold", [5_000, 10**9])
def test_events_in_view_equal_brute_force(spark, hold):
    events, looks = events_and_views(1, 400)
    got = views.events_in_view(spark.createDataFrame(events, EVENTS), spark.createDataFrame(looks, VIEWS), hold=hold)
    assert sorted((r.view_id, r.event_id) for r in got.collect()) == plain(events, looks, hold)
    assert len(plain(events, looks, hold)) > 50
    none = spark.createDataFrame([], EVENTS)
    assert views.events_in_view(none, spark.createDataFrame(looks, VIEWS)).count() == 0


def test_events_meet_few_updates_before_times_are_compared(spark):
    """One view moves a thousand times as often as the others, which hold long."""
    rng = random.Random(2)
    looks = [(v, 0, t, 0.0, 0.0, 800.0, 600.0, 1.0, 96.0, 2048, 2048, 4) for v, t in [(0, 10 * k) for k in range(3000)] + [(v, 1000 * v) for v in range(1, 25)]]
    events = [(i, 0, rng.randrange(30_000), 0, rng.randrange(2), 0) for i in range(600)]
    met = views.events_in_view(spark.createDataFrame(events, EVENTS), spark.createDataFrame(looks, VIEWS))
    found = met.count()
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and "_tile" in plan
    assert found == sum(1 + sum(1000 * v <= e[2] for v in range(1, 25)) for e in events)


def shuffled_rows(df):
    """Rows that the exchanges of a frame wrote, once it was collected."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        p = nodes.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        nodes += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_viewports_are_not_sent_as_tiles(spark):
    """Each viewport has some 600 tiles over blocks of several levels; tiles at the edges of blocks and of the image meet."""
    rng = random.Random(6)
    looks = [(v, v % 2, BASE + 1000 * k + v, rng.uniform(0, 900), rng.uniform(0, 900), 800.0, 600.0, 0.0625, 96.0, 16_000, 11_000, 6) for v in range(10) for k in range(20)]
    events = [(i, rng.randrange(2), BASE + rng.randrange(21_000), rng.randrange(5), rng.choice([0, 3, 6, 7, 8, 9, 12]), rng.choice([0, 7, 8, 9, 10])) for i in range(500)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = views.events_in_view(spark.createDataFrame(events, EVENTS), spark.createDataFrame(looks, VIEWS))
        got = sorted((r.view_id, r.event_id) for r in met.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain(events, looks, 10**9) and len(got) > 100
    assert len(events) < shuffled_rows(met) < len(events) + 20 * len(looks)


def test_events_in_view_as_two_streams_with_late_rows(spark, tmp_path):
    """Rows come out of order by up to 3 s, the watermark waits 5 s; one event and one update come after theirs and are left out."""
    hold = 8_000
    events, looks = events_and_views(3, 300)
    expected = plain(events, looks, hold)
    rng = random.Random(4)
    shuffled = lambda rows: sorted(rows, key=lambda r: r[2] + rng.uniform(0, 3000))
    events, looks = shuffled(events), shuffled(looks)
    e_cuts = [[e for e in events if a <= e[2] - BASE < a + 25_000] for a in range(0, 100_000, 25_000)]
    v_cuts = [[v for v in looks if a <= v[2] - BASE < a + 25_000] for a in range(0, 100_000, 25_000)]
    late_event, late_view = (9999, 0, BASE + 100, 0, 0, 0), (99, 0, BASE + 100, 0.0, 0.0, 800.0, 600.0, 1.0, 96.0, 2048, 2048, 4)
    e_cuts[3].append(late_event)
    v_cuts[3].append(late_view)
    end = 10**7  # the end of time, so that all before it is over
    e_cuts.append([(10_000, 77, end, 0, 0, 0)])
    v_cuts.append([(98, 77, end, *late_view[3:])])
    for k, (e, v) in enumerate(zip(e_cuts, v_cuts, strict=True)):
        spark.createDataFrame(e, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events/{k}")
        spark.createDataFrame(v, VIEWS).coalesce(1).write.parquet(f"{tmp_path}/views/{k}")
        read = lambda name, schema: timed("5 seconds")(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}"))
        with sessions.keyed_state(spark):
            out = views.events_in_view_stream(read("events", EVENTS), read("views", VIEWS), hold).select("view_id", "event_id")
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = sorted((r.view_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == expected and len(expected) > 50


def test_events_of_a_stream_are_joined_by_buckets_of_time(spark, tmp_path):
    """Else each update is compared with all events of its tiles that are kept."""
    for name, schema in (("events", EVENTS), ("views", VIEWS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: timed("5 seconds")(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"))
    plan = views.events_in_view_stream(read("events", EVENTS), read("views", VIEWS), 8_000)._jdf.queryExecution().analyzed().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_at#" in join and "_bucket#" in join


def test_events_of_a_stream_are_kept_as_bundles(spark, tmp_path):
    """Many events of a block and time are a few rows of the join's state; other columns of theirs come back as they were."""
    rng = random.Random(8)
    looks = [(v, 0, BASE + 1000 * k + v, 0.0, 0.0, 800.0, 600.0, 1.0, 96.0, 2048, 2048, 4) for v in range(3) for k in range(5)]
    events = [(i, 0, BASE + rng.randrange(4000), rng.randrange(2), rng.randrange(3), rng.randrange(3)) for i in range(900)]
    end = 10**7
    expected = plain(events, looks, 10_000)
    more = lambda e: (*e, None if e[0] % 3 else 2**60 + e[0], None if e[0] % 2 else float("nan"), [e[0], None])
    schema = f"{EVENTS}, big long, part double, list array<long>"
    for name, rows, kind in (("events", [more(e) for e in [*events, (10_000, 77, end, 0, 0, 0)]], schema), ("views", [*looks, (98, 77, end, *looks[0][3:])], VIEWS)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda name, kind: timed("5 seconds")(spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}"))
    with sessions.keyed_state(spark):
        out = views.events_in_view_stream(read("events", schema), read("views", VIEWS), 10_000)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.view_id, r.event_id) for r in got.collect()) == expected and len(expected) > 600
    given = timed("5 seconds")(spark.read.schema(schema).parquet(f"{tmp_path}/events"))
    assert got.columns == ["view_id", *given.columns] and [d for d in got.dtypes if d[0] != "view_id"] == given.dtypes
    assert got.drop("view_id").exceptAll(given.join(got.select("view_id", "event_id"), "event_id").select(given.columns)).count() == 0
    kept = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators if o.operatorName == "symmetricHashJoin"]
    assert 0 < kept[0] < 60


def test_the_state_store_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with sessions.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_metrics_are_kept_once_for_each_batch(spark, tmp_path):
    from pyspark.sql import Observation

    from tilewright.streaming import metrics

    counters = {"n": F.count("*")} | metrics.histogram("ms", F.col("ms"), (1, 10))
    path = str(tmp_path / "m")
    seen = Observation("batch")
    metrics.observed(spark.createDataFrame([(1.0,), (5.0,), (None,), (50.0,)], "ms double"), seen, counters).write.format("noop").mode("overwrite").save()
    for _ in range(2):
        metrics.kept(path, "batch", "r", 0, seen.get)
    metrics.kept(path, "batch", "r", 1, {"n": 2, "ms_le_1": None, "ms_le_10": 2, "ms_count": 2, "ms_sum": 4.5})
    assert {r.metric: r.value for r in metrics.totals(spark, path).collect()} == {"n": 6.0, "ms_le_1": 1.0, "ms_le_10": 4.0, "ms_count": 5.0, "ms_sum": 60.5}
