"""Viewports over pyramids: level choice, visible tiles, order of sending, caches and their eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import pyramid, ranks
from tilewright.session import spread

#: Tiles of one update; soft and hard limit of what a view remembers; entries dropped softly; zoom limits.
MOST_TILES, SOFT, HARD, BATCH = 64, 500, 1000, 256
LEAST_ZOOM, MOST_ZOOM = 0.01, 64.0


def half_up(x: Column) -> Column:
    """Rounds halves up, for negatives too."""
    return F.floor(x + 0.5)


def round_to(x: Column, digits: int) -> Column:
    return half_up(x * 10.0**digits) / F.lit(10.0**digits)


def safe_zoom(zoom: Column) -> Column:
    return F.greatest(zoom, F.lit(1e-6))


def ideal_level(zoom: Column, dpi: Column, levels: Column) -> Column:
    """0 if a pixel covers a screen pixel, else round(-log2), within the levels."""
    scale = safe_zoom(zoom) * dpi / F.lit(96.0)
    return F.greatest(F.lit(0), F.least(F.when(scale >= 1, F.lit(0)).otherwise(half_up(-F.log2(scale))).cast("int"), levels - 1))


def min_level(zoom: Column, dpi: Column, levels: Column) -> Column:
    """Two levels finer than ideal, within the levels; 0 without any."""
    scale = safe_zoom(zoom) * dpi / F.lit(96.0)
    ideal = F.when(scale >= 1, F.lit(0)).otherwise(half_up(-F.log2(scale))).cast("int")
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), ideal - 2), levels - 1))


def tile_range(views: DataFrame) -> DataFrame:
    """Adds first and end (exclusive) tile of both axes at column ``level``: tx0, tx1, ty0, ty1."""
    step = F.pow(F.lit(2.0), F.col("level")) * pyramid.TILE
    zoom = safe_zoom(F.col("zoom"))
    along = lambda p, view, size: (
        F.greatest(F.lit(0), F.floor(F.col(p) / step)).cast("int"),
        F.least(F.greatest(F.lit(0), F.ceil((F.col(p) + F.col(view) / zoom) / step)), F.ceil(F.col(size) / step)).cast("int"),
    )
    (x0, x1), (y0, y1) = along("view_x", "view_width", "width"), along("view_y", "view_height", "height")
    return views.withColumns({"tx0": x0, "tx1": x1, "ty0": y0, "ty1": y1})


def level_ranges(view_x: Column, view_y: Column, view_width: Column, view_height: Column, zoom: Column, dpi: Column, width: Column, height: Column, levels: Column) -> Column:
    """Tiles in view as an array, coarsest level first: level, tx0, tx1, ty0, ty1, ends exclusive.

    One expression of one row, so it serves streams, where rows can't be numbered.
    """
    first, span = min_level(zoom, dpi, levels), safe_zoom(zoom)

    def of(level: Column) -> Column:
        step = F.pow(F.lit(2.0), level) * pyramid.TILE
        start = lambda p: F.greatest(F.lit(0), F.floor(p / step)).cast("int")
        end = lambda p, view, size: F.least(F.greatest(F.lit(0), F.ceil((p + view / span) / step)), F.ceil(size / step)).cast("int")
        return F.struct(level.alias("level"), start(view_x).alias("tx0"), end(view_x, view_width, width).alias("tx1"), start(view_y).alias("ty0"), end(view_y, view_height, height).alias("ty1"))

    none = F.array().cast("array<int>")
    return F.transform(F.when(levels > 0, F.sequence(levels - 1, first, F.lit(-1))).otherwise(none), of)


def keys_in(ranges: Column) -> Column:
    """Keys of all tiles of an array of level ranges."""
    none = F.array().cast("array<int>")
    span = lambda r, a, b: F.when(r[b] > r[a], F.sequence(r[a], r[b] - 1)).otherwise(none)
    row = lambda r, y: F.transform(span(r, "tx0", "tx1"), lambda x: pyramid.pack_key(x, y, r["level"]))
    return F.flatten(F.transform(ranges, lambda r: F.flatten(F.transform(span(r, "ty0", "ty1"), lambda y: row(r, y)))))


def nearest_keys(r: Column, centre_x: Column, centre_y: Column, most: int) -> Column:
    """Keys of a level's tiles (level, tx0, tx1, ty0, ty1) by the distance of their corners, ties by y, then x (O3)."""
    step = F.pow(F.lit(2.0), r["level"]) * pyramid.TILE
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(r[b] > r[a], F.sequence(r[a], r[b] - 1)).otherwise(none)
    away = lambda t, c: F.pow(t * step - c, F.lit(2))
    tile = lambda x, y: F.struct((away(x, centre_x) + away(y, centre_y)).alias("d"), y.alias("y"), x.alias("x"))
    tiles = F.flatten(F.transform(span("ty0", "ty1"), lambda y: F.transform(span("tx0", "tx1"), lambda x: tile(x, y))))
    return F.transform(F.slice(F.array_sort(tiles), 1, most), lambda t: pyramid.pack_key(t["x"], t["y"], r["level"]))


def visible_tiles(views: DataFrame, first: Column | None = None, margin: int = 0) -> DataFrame:
    """One row per visible tile of each view at levels ``first`` to the coarsest.

    ``views``: view_x, view_y, view_width, view_height, zoom, dpi, width, height, levels. ``margin`` adds a ring of
    tiles, within the image (T17). Views are dealt over tasks before they become tiles.
    """
    first = min_level(F.col("zoom"), F.col("dpi"), F.col("levels")) if first is None else first
    none = F.array().cast("array<int>")
    v = spread(views, 10_000).withColumn("level", F.explode(F.when(F.col("levels") > 0, F.sequence(first, F.col("levels") - 1)).otherwise(none)))
    v = tile_range(v)
    if margin:
        step = F.pow(F.lit(2.0), F.col("level")) * pyramid.TILE
        most = lambda size: F.ceil(F.col(size) / step).cast("int")
        v = v.withColumns({"tx0": F.greatest(F.lit(0), F.col("tx0") - margin), "ty0": F.greatest(F.lit(0), F.col("ty0") - margin), "tx1": F.least(most("width"), F.col("tx1") + margin), "ty1": F.least(most("height"), F.col("ty1") + margin)})
    span = lambda a, b: F.explode(F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(none))
    return v.withColumn("y", span("ty0", "ty1")).withColumn("x", span("tx0", "tx1")).drop("tx0", "tx1", "ty0", "ty1")


def prefetch_ring(views: DataFrame, level: Column, decoded: DataFrame, ring: int = 3, most: int = 8) -> DataFrame:
    """Decoded tiles around the visible ones at one level, row by row, ``most`` of each view.

    ``decoded``: view_id, level, x, y of the tiles that a view's cache holds decoded.
    """
    # A view's own range tells which tiles it sees, so they are not joined; tiles are many, so none are broadcast.
    outer = tile_range(visible_tiles(views, level, ring).where(F.col("level") == level))
    around = outer.where(~(F.col("x").between(F.col("tx0"), F.col("tx1") - 1) & F.col("y").between(F.col("ty0"), F.col("ty1") - 1))).drop("tx0", "tx1", "ty0", "ty1")
    around = around.join(decoded.select("view_id", "level", "x", "y").hint("merge"), ["view_id", "level", "x", "y"], "left_semi")
    w = Window.partitionBy("view_id").orderBy("y", "x")
    return around.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def corner_distance() -> Column:
    """Squared distance of a tile's corner from the view's centre, zoom left out: the sender's order (O3, Q11)."""
    step = F.pow(F.lit(2.0), F.col("level")) * pyramid.TILE
    away = lambda t, p, size: F.pow(F.col(t) * step - (F.col(p) + F.col(size) / 2), F.lit(2))
    return away("x", "view_x", "view_width") + away("y", "view_y", "view_height")


def centre_distance() -> Column:
    """Distance of a tile's centre from the view's, in full-size pixels: the viewer's order."""
    step = F.pow(F.lit(2.0), F.col("level")) * pyramid.TILE
    zoom = safe_zoom(F.col("zoom"))
    return F.hypot((F.col("x") + 0.5) * step - (F.col("view_x") + F.col("view_width") / zoom / 2), (F.col("y") + 0.5) * step - (F.col("view_y") + F.col("view_height") / zoom / 2))


def to_send(tiles: DataFrame, sent: DataFrame | None = None, most: int = MOST_TILES, cut_first: bool = True) -> DataFrame:
    """Tiles of each view in the order of sending (O3, O4, O5, J5): the nearest ``most`` of a level, minus those sent,
    coarse levels first, ``most`` in all. ``cut_first=False`` takes away those sent before the cut (Q13).

    Ties of distance go by y, then x.
    """
    tiles = tiles.withColumn("distance", corner_distance())
    minus = lambda t: t if sent is None else t.join(sent.select("view_id", "level", "x", "y").hint("merge"), ["view_id", "level", "x", "y"], "left_anti")
    nearest = Window.partitionBy("view_id", "level").orderBy("distance", "y", "x")
    cut = lambda t: t.withColumn("in_level", F.row_number().over(nearest)).where(F.col("in_level") <= most)
    chosen = minus(cut(tiles)) if cut_first else cut(minus(tiles))
    order = Window.partitionBy("view_id").orderBy(F.desc("level"), "in_level")
    return chosen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def best_available(tiles: DataFrame, held: DataFrame, keys: Sequence[str], top: str) -> DataFrame:
    """For each tile the finest held tile at or above it: an as-of join over levels (J8). Null if none. No tiles are broadcast."""
    up = pyramid.ancestors(tiles, top)
    h = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("level").alias("_l"), F.col("x").alias("_x"), F.col("y").alias("_y")).hint("merge")
    same = (up["up"] == h["_l"]) & (up["up_x"] == h["_x"]) & (up["up_y"] == h["_y"])
    for k in keys:
        same = same & (up[k] == h[f"_{k}"])
    own = [*keys, "level", "x", "y"]
    found = up.join(h, same).groupBy(*own).agg(F.min(F.struct(F.col("up").alias("source_level"), F.col("up_x").alias("source_x"), F.col("up_y").alias("source_y"))).alias("s"))
    return tiles.join(found.hint("merge"), own, "left").select(*[tiles[c] for c in tiles.columns], "s.*")


def source_part(level: Column, x: Column, y: Column, up: Column, width: Column, height: Column, bitmap_width: Column, bitmap_height: Column) -> dict[str, Column]:
    """The part of an ancestor's bitmap that shows a tile: sx, sy, s_width, s_height in its pixels.

    Both tiles end at the image's edge, and the bitmap stands for what is left of its tile.
    """
    step, by = F.pow(F.lit(2.0), level) * pyramid.TILE, F.pow(F.lit(2.0), up - level)

    def along(t: Column, size: Column, bitmap: Column) -> tuple[Column, Column]:
        start, over = t * step, F.floor(t / by) * by * step
        span = F.greatest(F.lit(1.0), F.least(over + by * step, size) - over)
        return (start - over) / span * bitmap, (F.least(start + step, size) - start) / span * bitmap

    (sx, s_width), (sy, s_height) = along(x, width, bitmap_width), along(y, height, bitmap_height)
    return {"sx": sx, "sy": sy, "s_width": s_width, "s_height": s_height}


def prune(entries: DataFrame, view: str, at: str, hard: bool) -> DataFrame:
    """Entries that stay when a view holds too many (O8): those from the k-th smallest time on, ties too.

    Soft: over SOFT, k = BATCH; hard: over HARD, k = entries - SOFT. Views that hold few are left alone; the others' cut is
    found by ``ranks.numbered``, so a view of any size is spread.
    """
    limit = HARD if hard else SOFT
    sizes = entries.groupBy(view).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    k = F.least(F.col("_n") - SOFT if hard else F.lit(BATCH), F.col("_n") - 1)
    cuts = sizes.select(F.col(view).alias("_view"), (k + 1).alias("_k"))
    times = entries.join(cuts, entries[view].eqNullSafe(cuts["_view"])).select("_view", "_k", F.col(at).alias("_at"))
    cut = ranks.numbered(times, ["_view"], ["_at"], "_nth").where("_nth = _k").select("_view", F.col("_at").alias("_cut"))
    both = entries.join(cut, entries[view].eqNullSafe(cut["_view"]), "left")
    return both.where(F.col("_cut").isNull() | (F.col(at) >= F.col("_cut"))).select(*[entries[c] for c in entries.columns])


def evict_least_recent(entries: DataFrame, cache: str, at: str, size: str, id_column: str, most_tiles: int, most_bytes: int, protected: DataFrame | None = None) -> DataFrame:
    """Entries to evict from each cache (O9, J6): if tiles or bytes are over their limit, the least recently used that
    are not protected, until both are at 80 %. ``protected``: (cache, id) of tiles in view. Times and ids are numbers.
    """
    held = entries.groupBy(cache).agg(F.count("*").alias("_tiles"), F.sum(size).alias("_bytes")).where((F.col("_tiles") > most_tiles) | (F.col("_bytes") > most_bytes)).withColumnRenamed(cache, "_cache")
    e = entries.join(held, entries[cache].eqNullSafe(held["_cache"])).drop("_cache")
    if protected is not None:
        e = e.join(protected.select(cache, id_column), [cache, id_column], "left_anti")
    e = ranks.numbered(e, [cache], [at, id_column], "_nth", running=(size, "_freed"))
    still = (F.col("_tiles") - F.col("_nth") + 1 > int(most_tiles * 0.8)) | (F.col("_bytes") - F.col("_freed") > int(most_bytes * 0.8))
    return e.where(still).select(*entries.columns)


def cache_use(entries: DataFrame, cache: str, size: str, decoded: str) -> DataFrame:
    """Bytes and decoded tiles of each cache: compressed bytes, and 4 bytes a pixel once decoded."""
    return entries.groupBy(cache).agg(F.sum(F.col(size) + F.when(F.col(decoded), 4 * pyramid.TILE**2).otherwise(0)).alias("bytes"), F.count_if(decoded).alias("decoded"))


def clamped(x: Column, y: Column, view_width: Column, view_height: Column, zoom: Column, width: Column, height: Column) -> dict[str, Column]:
    """x and y such that half the image or half the view stays in sight."""

    def along(p: Column, view: Column, size: Column) -> Column:
        seen = view / safe_zoom(zoom)
        margin = F.least(seen * 0.5, size * 0.5)
        low, high = -margin, size - seen + margin
        return F.when(low > high, (low + high) / 2).otherwise(F.greatest(low, F.least(p, high)))

    return {"x": along(x, view_width, width), "y": along(y, view_height, height)}


def zoomed(x: Column, y: Column, zoom: Column, screen_x: Column, screen_y: Column, delta: Column) -> dict[str, Column]:
    """x, y and zoom after zooming about a point of the screen, before clamping."""
    new = F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), zoom * delta))
    return {"x": x + screen_x / zoom - screen_x / new, "y": y + screen_y / zoom - screen_y / new, "zoom": new}


def panned(x: Column, y: Column, zoom: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """x and y after dragging, before clamping."""
    return {"x": x - dx / safe_zoom(zoom), "y": y - dy / safe_zoom(zoom)}


def fitted(view_width: Column, view_height: Column, width: Column, height: Column, padding: float = 0.9) -> dict[str, Column]:
    """x, y and zoom that show a whole image in the middle."""
    zoom = F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), view_width * padding / width, view_height * padding / height))
    return {"x": (width - view_width / zoom) / 2, "y": (height - view_height / zoom) / 2, "zoom": zoom}


def to_screen(x: Column, y: Column, view_x: Column, view_y: Column, zoom: Column) -> dict[str, Column]:
    """Image to screen; the inverse is x / zoom + view_x."""
    return {"screen_x": (x - view_x) * zoom, "screen_y": (y - view_y) * zoom}


def minimap(size: float, width: Column, height: Column, levels: Column) -> dict[str, Column]:
    """Scale of the minimap, and its level: the coarsest of at most 8 by 8 tiles."""
    few = F.filter(F.sequence(F.lit(0), levels - 1), lambda n: (pyramid.tiles_along(width, n) <= 8) & (pyramid.tiles_along(height, n) <= 8))
    return {"scale": F.least(F.lit(size) / width, F.lit(size) / height), "level": F.coalesce(F.array_max(few), levels - 1)}


def scale_bar(view_width: Column, microns_per_pixel: Column, zoom: Column, nice: Sequence[float] = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)) -> Column:
    """The longest round length of at most 15 % of the view's width, else 1."""
    room = view_width * 0.15 * microns_per_pixel / safe_zoom(zoom)
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, map(float, nice))), lambda n: n <= room)), F.lit(1.0))
