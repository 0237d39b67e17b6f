"""Live sessions: what each open view has been sent, as one stateful stream with a map of tiles for each view."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators import viewport

#: A request passes 2 s after the last; superseded tiles look 28 s old; a view forgets after 10 minutes.
AGAIN_MS, SUPERSEDED_MS, FORGET_MS = 2_000, 28_000, 600_000
#: Numbers of a level in ``ranges``: level, tx0, tx1, ty0, ty1.
WIDE = 5

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The session's state store is RocksDB while a query is started in here, as ``transformWithState`` needs; a query
    keeps the store that it was started with, and the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Limits(NamedTuple):
    """Times in milliseconds, tiles of an update, and what a view remembers: see ``viewport`` and the fixed values above."""

    again: int = AGAIN_MS
    superseded: int = SUPERSEDED_MS
    forget: int = FORGET_MS
    most: int = viewport.MOST_TILES
    soft: int = viewport.SOFT
    hard: int = viewport.HARD
    batch: int = viewport.BATCH


class Tile(NamedTuple):
    """Of a tile in a view's map: how often and when it was last asked for, whether it was delivered, the update in force
    when it was dispatched last, and the update whose list it stands in."""

    count: int
    last: int
    delivered: bool
    live: int
    listed: int


class View:
    """The rules of one view, over a dictionary of tiles. Every method returns the keys that go out."""

    def __init__(self, limits: Limits, tiles: dict[int, Tile], updates: int = 0, ranges: list[int] | None = None, seen: int | None = None):
        self.limits, self.tiles, self.updates, self.ranges, self.seen = limits, tiles, updates, ranges or [], seen

    def forget(self) -> None:
        """All is let go (ST17)."""
        self.tiles.clear()
        self.ranges, self.updates = [], self.updates + 1

    def sees(self, key: int) -> bool:
        """Whether a tile lies in the last viewport, at one of its levels (ST7)."""
        x, y, level = key & 0xFFFFF, key >> 20 & 0xFFFFF, key >> 40
        for i in range(0, len(self.ranges), WIDE):
            n, x0, x1, y0, y1 = self.ranges[i : i + WIDE]
            if n == level:
                return x0 <= x < x1 and y0 <= y < y1
        return False

    def _dispatch(self, key: int, at: int, listed: bool) -> None:
        old = self.tiles.get(key)
        self.tiles[key] = Tile(old.count + 1 if old else 1, at, False, self.updates, self.updates if listed else old.listed if old else 0)

    def _prune(self, n: int) -> None:
        """Tiles older than the n-th go."""
        times = sorted(t.last for t in self.tiles.values())
        cut = times[min(n, len(times) - 1)]
        for key in [k for k, t in self.tiles.items() if t.last < cut]:
            del self.tiles[key]

    def update(self, at: int, wanted: list[int], ranges: list[int]) -> list[int]:
        """A new viewport: what the last one listed looks old (ST6), and wanted tiles that are not known go out (ST4)."""
        for key, t in self.tiles.items():
            if t.listed and t.listed == self.updates:
                self.tiles[key] = t._replace(last=min(t.last, at - self.limits.superseded))
        self.updates, self.ranges = self.updates + 1, ranges
        if len(self.tiles) > self.limits.hard:
            self._prune(len(self.tiles) - self.limits.soft)
        out = [k for k in wanted if k not in self.tiles][: self.limits.most]
        for key in out:
            self._dispatch(key, at, True)
        return out

    def made(self, at: int, key: int) -> list[int]:
        """A tile has been made: it goes out if it is not known and in view (ST7)."""
        if key in self.tiles or not self.sees(key):
            return []
        self._dispatch(key, at, False)
        return [key]

    def request(self, at: int, key: int) -> list[int]:
        """A tile is asked for again: it goes out if it was not asked for just now (ST5)."""
        if key in self.tiles and at - self.tiles[key].last < self.limits.again:
            return []
        self._dispatch(key, at, False)
        return [key]

    def fetched(self, key: int) -> list[int]:
        """A worker has a tile: it is delivered once, if no update came between and it is in view (ST8)."""
        t = self.tiles.get(key)
        if t is None or t.delivered or t.live != self.updates or not self.sees(key):
            return []
        self.tiles[key] = t._replace(delivered=True)
        return [key]

    def tick(self) -> None:
        """Now and then the oldest go."""
        if len(self.tiles) > self.limits.soft:
            self._prune(self.limits.batch)


class Delivery(StatefulProcessor):
    """State of a view: a value with its last viewport, a map of tiles by key, and one timer that lets both go."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.view = handle.getValueState("view", "updates long, seen long, timer long, ranges array<int>")
        self.sent = handle.getMapState("sent", "key long", "count long, last long, delivered boolean, live long, listed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.view.get() if self.view.exists() else None
        updates, seen, timer, ranges = held if held is not None else (0, None, None, [])
        before = {k[0]: Tile(*v) for k, v in self.sent.iterator()} if held is not None else {}
        view = View(self.limits, dict(before), updates, list(ranges), seen)
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "nth"], kind="stable").itertuples():
            if view.seen is not None and row.at - view.seen >= self.limits.forget:
                view.forget()
            view.seen = row.at if view.seen is None else max(view.seen, row.at)
            n, kind, got = len(out), "send", []
            if row.kind == "open":
                view.forget()
            elif row.kind == "update":
                got = view.update(row.at, [int(k) for k in row.wanted], [int(k) for k in row.ranges])
            elif row.kind == "tick":
                view.tick()
            elif row.kind == "fetched":
                kind, got = "deliver", view.fetched(int(row.key))
            else:
                got = (view.made if row.kind == "made" else view.request)(row.at, int(row.key))
            out += [(*key, kind, k, row.at, n + i) for i, k in enumerate(got)]
        for k in before.keys() - view.tiles.keys():
            self.sent.removeKey((k,))
        for k, t in view.tiles.items():
            if before.get(k) != t:
                self.sent.updateValue((k,), tuple(t))
        if timer is None:
            timer = view.seen + self.limits.forget
            self.handle.registerTimer(timer)
        self.view.update((view.updates, view.seen, timer, view.ranges))
        if out:
            yield pd.DataFrame(out, columns=["view", "kind", "key", "at", "turn"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        updates, seen, _, ranges = self.view.get()
        if timerValues.getCurrentWatermarkInMs() >= seen + self.limits.forget:
            self.view.clear()
            self.sent.clear()
        else:
            self.handle.registerTimer(seen + self.limits.forget)
            self.view.update((updates, seen, seen + self.limits.forget, ranges))
        return iter([])

    def close(self) -> None:
        pass


def sent_tiles(actions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A stream of what happens in views to the stream of tiles that go out (ST4 to ST8, ST17).

    ``actions``: view (session and slot in one), kind, at (ms), nth (order of equal times), key, wanted, ranges, and an
    event time with a watermark. Kinds: open (the slot is replaced), update (a new viewport with the tiles ``wanted``, see
    ``wanted``, and ``ranges``, see ``viewport.level_ranges``), made (a tile has been made), request (asked for again),
    fetched (a worker has it) and tick. Rows of a view are taken in the order of at and nth within a trigger. A view that
    nothing happens in for ``limits.forget`` is forgotten. Returns view, kind (send or deliver), key, at, and turn, the
    order within the trigger. Start it within ``keyed_state``.
    """
    kind = dict(actions.dtypes)["view"]
    rows = actions.groupBy("view")
    return rows.transformWithStateInPandas(Delivery(limits), f"view {kind}, kind string, key long, at long, turn long", "append", "EventTime")


def tiles_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The map of every view after the last trigger of a query of ``sent_tiles``: view, key, count, last, delivered."""
    state = spark.read.format("statestore").option("stateVarName", "sent").load(checkpoint)
    v = F.col("user_map_value")
    return state.select("key.view", F.col("user_map_key.key").alias("key"), *[v[c].alias(c) for c in ("count", "last", "delivered")])


def wanted(ranges: Column, centre_x: Column, centre_y: Column, most: int = viewport.MOST_TILES) -> Column:
    """Keys of an update's tiles in the order of sending: coarse levels first, the nearest ``most`` of each."""
    return F.flatten(F.transform(ranges, lambda r: viewport.nearest_keys(r, centre_x, centre_y, most)))
