"""Tile pyramids: levels, grids, keys, rectangles, empty regions and progress."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tilewright.session import spread

#: Pixels of a tile's edge; bits of x and y in a key.
TILE, BITS = 512, 20


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / (F.lit(b) if isinstance(b, int) else b))


def max_level(width: Column, height: Column) -> Column:
    """0 up to one tile, else ceil(log2(longer edge / tile))."""
    longest = F.greatest(width, height)
    return F.when(longest <= TILE, F.lit(0)).otherwise(F.ceil(F.log2(longest / F.lit(TILE)))).cast("int")


def level_count(width: Column, height: Column, client: bool = False) -> Column:
    """Levels of a pyramid; ``client`` gives the viewer's count, which falls to 0 and below for images under a tile."""
    if client:
        return (F.ceil(F.log2(F.greatest(width, height) / F.lit(TILE))) + 1).cast("int")
    return max_level(width, height) + 1


def tiles_along(size: Column, level: Column) -> Column:
    """Tiles of an edge at a level."""
    return ceil_div(F.ceil(size / F.pow(F.lit(2.0), level)), TILE).cast("long")


def levels(images: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """One row per image and level with tiles_x and tiles_y."""
    exploded = images.withColumn("level", F.explode(F.sequence(F.lit(0), max_level(F.col(width), F.col(height)))))
    return exploded.withColumns({"tiles_x": tiles_along(F.col(width), F.col("level")), "tiles_y": tiles_along(F.col(height), F.col("level"))})


def total_tiles(images: DataFrame, key: str, width: str = "width", height: str = "height") -> DataFrame:
    """Tiles of all levels of each image (A2)."""
    return levels(images, width, height).groupBy(key).agg(F.sum(F.col("tiles_x") * F.col("tiles_y")).alias("tiles"))


def grid(images: DataFrame, width: str = "width", height: str = "height", skip: int | None = None) -> DataFrame:
    """One row per tile with level, x, y and its row-major number in the level; the first ``skip`` of a level left out (T4).

    Rows are numbered by arithmetic; images are dealt over tasks before they become tiles.
    """
    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = levels(spread(images, 10_000), width, height).withColumn("y", F.explode(upto("tiles_y"))).withColumn("x", F.explode(upto("tiles_x")))
    rows = rows.withColumn("number", F.col("y") * F.col("tiles_x") + F.col("x"))
    return rows.where(F.col("number") >= skip) if skip else rows


def rectangle(x: Column, y: Column, level: Column, width: Column, height: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of a tile in full-size pixels, cut off at the image's edge (T5)."""
    step = F.pow(F.lit(2.0), level) * TILE
    return {"x0": (x * step).cast("long"), "y0": (y * step).cast("long"), "x1": F.least(((x + 1) * step).cast("long"), width), "y1": F.least(((y + 1) * step).cast("long"), height)}


def pack_key(x: Column, y: Column, level: Column) -> Column:
    """x | y << 20 | level << 40."""
    return x.cast("long").bitwiseOR(F.shiftleft(y.cast("long"), BITS)).bitwiseOR(F.shiftleft(level.cast("long"), 2 * BITS))


def unpack_key(key: Column) -> dict[str, Column]:
    mask = F.lit((1 << BITS) - 1).cast("long")
    return {"x": key.bitwiseAND(mask), "y": F.shiftright(key, BITS).bitwiseAND(mask), "level": F.shiftright(key, 2 * BITS).bitwiseAND(mask)}


def ancestors(tiles: DataFrame, top: str) -> DataFrame:
    """Each tile with every coarser tile over it: up, up_x, up_y, from its own level to column ``top``."""
    up = tiles.withColumn("up", F.explode(F.when(F.col(top) >= F.col("level"), F.sequence("level", top)).otherwise(F.array().cast("array<int>"))))
    by = F.pow(F.lit(2.0), F.col("up") - F.col("level"))
    return up.withColumns({"up_x": F.floor(F.col("x") / by).cast("int"), "up_y": F.floor(F.col("y") / by).cast("int")})


def without_empty(tiles: DataFrame, empty: DataFrame, key: str, top: str = "max_level") -> DataFrame:
    """Tiles with no empty tile at or above them (T16, J7): one anti-join on all ancestors, whatever the depth.

    Tiles made of a small table look as small to Spark, so both joins ask for a merge: no tiles are broadcast.
    """
    e = empty.select(F.col(key).alias("_k"), F.col("level").alias("_l"), F.col("x").alias("_x"), F.col("y").alias("_y")).hint("merge")
    up = ancestors(tiles, top)
    lost = up.join(e, (up[key] == e["_k"]) & (up["up"] == e["_l"]) & (up["up_x"] == e["_x"]) & (up["up_y"] == e["_y"]), "left_semi")
    return tiles.join(lost.select(key, "level", "x", "y").hint("merge"), [key, "level", "x", "y"], "left_anti")


def descendants(tiles: DataFrame, down: Column) -> DataFrame:
    """The 2**down by 2**down finer tiles under each tile: below, below_x, below_y."""
    n = F.pow(F.lit(2.0), down).cast("int")
    span = F.sequence(F.lit(0), n - 1)
    wide = tiles.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
    return wide.withColumns({"below": F.col("level") - down, "below_x": F.col("x") * n + F.col("_dx"), "below_y": F.col("y") * n + F.col("_dy")}).drop("_dx", "_dy")


def best_native(images: DataFrame, key: str, downsamples: str, level: Column) -> DataFrame:
    """Number of the native level with the largest downsample up to 2**level, else 0 (O12), and the fallbacks after it down to 0."""
    pairs = F.transform(F.col(downsamples), lambda d, i: F.struct(d.alias("downsample"), i.alias("native")))
    usable = F.filter(pairs, lambda p: p["downsample"] <= F.pow(F.lit(2.0), level))
    best = F.coalesce(F.array_max(usable)["native"], F.lit(0))
    return images.select(key, best.alias("native"), F.sequence(best, F.lit(0)).alias("tries"))


def progress(done: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Completed and total tiles of each image, every completed level counted once (A3, M9, Q2)."""
    got = done.groupBy(key).agg(F.sum("completed_up_to").alias("completed"))
    whole = (F.col("tiles") > 0) & (F.coalesce("completed", F.lit(0)) >= F.col("tiles"))
    return totals.join(got, key, "left").select(key, "tiles", F.coalesce("completed", F.lit(0)).alias("completed"), whole.alias("complete"))


def is_black(pixels: Column) -> Column:
    """A binary RGBA column holds no red, green or blue above 0; alpha is ignored."""
    @pandas_udf("boolean")
    def black(raw: pd.Series) -> pd.Series:
        import numpy as np

        return raw.map(lambda b: None if b is None else not np.frombuffer(b, np.uint8)[: len(b) // 4 * 4].reshape(-1, 4)[:, :3].any())

    return black(pixels)
