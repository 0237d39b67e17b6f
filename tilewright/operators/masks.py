"""Bit-packed masks: rows of ceil(width / 8) bytes, the lowest bit leftmost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from tilewright.session import spread

#: Edge of the patches that brushes paint on, pixels of a word, and patches that a task writes at a time.
PATCH, WORD, PATCHES = 512, 32, 256


def stride(width: Column) -> Column:
    """Bytes of a row (B1)."""
    return F.ceil(width / F.lit(8)).cast("int")


def expected_size(width: Column, height: Column) -> Column:
    return stride(width) * height


def get_pixel(data: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """A pixel; false outside (B2)."""
    byte = F.conv(F.hex(F.substring(data, y * stride(width) + F.floor(x / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.when(inside, F.getbit(byte, F.pmod(x, F.lit(8)))  == 1).otherwise(F.lit(False))


def popcount(data: Column) -> Column:
    """Bits set in a binary column (A5), without Python."""
    return F.bitmap_count(data)


def popcount_inside(data: Column, width: Column) -> Column:
    """Bits set, those that pad rows left out."""

    @pandas_udf("long")
    def count(d: pd.Series, w: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, n):
            if b is None or not n:
                return None if b is None else 0
            rows = np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, -(-n // 8)), axis=1, bitorder="little")
            return int(rows[:, :n].sum())

        return pd.Series([one(b, int(n)) for b, n in zip(d, w, strict=True)], dtype="Int64")

    return count(data, width)


#: Pixels that a task holds as one byte each while it packs or unpacks.
STEP_PIXELS = 1 << 24


def _runs(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places, each as long as its sizes sum up to ``most``, one place at least."""
    import numpy as np

    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, stop
        at = stop


def packed(raster: Column) -> Column:
    """array<array<boolean>> to packed rows."""

    @arrow_udf("binary")
    def pack(rasters: pa.Array) -> pa.Array:
        import numpy as np

        def part(r):
            rows = r.flatten()
            widths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = rows.flatten().fill_null(False).to_numpy(zero_copy_only=False)
            strides = -(-widths // 8)
            shift = 8 * (np.cumsum(strides) - strides) - (np.cumsum(widths) - widths)
            if shift.any():
                wide = np.zeros(8 * int(strides.sum()), bool)
                wide[np.arange(len(bits)) + np.repeat(shift, widths)] = bits
                bits = wide
            raw = np.packbits(bits, bitorder="little").tobytes()
            ends = np.concatenate([[0], np.cumsum(strides)])[np.concatenate([[0], np.cumsum(r.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
            return pa.array([None if gone else raw[a:b] for gone, a, b in zip(r.is_null().to_pylist(), ends[:-1], ends[1:], strict=True)], pa.binary())

        # Pixels of a raster: those between its first row's start and its last row's end.
        inner = rasters.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(rasters.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        pixels = np.diff(np.concatenate([[0], np.cumsum(inner)])[ends])
        return pa.concat_arrays([pa.array([], pa.binary()), *[part(rasters.slice(a, b - a)) for a, b in _runs(pixels, STEP_PIXELS)]])

    return pack(raster)


def unpacked(data: Column, width: Column) -> Column:
    """Packed rows to array<array<boolean>> (B4); an error if the length is no multiple of the row's (F8)."""

    @arrow_udf("array<array<boolean>>")
    def unpack(d: pa.Array, w: pa.Array) -> pa.Array:
        import numpy as np

        # Both kinds of null: rows without a mask stay null.
        gone = d.is_null().to_numpy(zero_copy_only=False)
        sizes = np.array([0 if b is None else len(b) for b in d.to_pylist()], np.int64)
        widths = w.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        strides = -(-widths // 8)
        for n, step in zip(sizes[~gone], strides[~gone], strict=True):
            if n % step if step else n:
                raise ValueError(f"{n} bytes are no whole rows of {step}")

        def part(a, b):
            raw = np.frombuffer(b"".join(x for x in d.slice(a, b - a).to_pylist() if x is not None), np.uint8)
            bits = np.unpackbits(raw, bitorder="little").view(bool)
            rows = sizes[a:b] // np.maximum(strides[a:b], 1)
            row_width, row_stride = np.repeat(widths[a:b], rows), np.repeat(strides[a:b], rows)
            if (row_width != 8 * row_stride).any():
                place = np.arange(len(bits)) - np.repeat(8 * (np.cumsum(row_stride) - row_stride), 8 * row_stride)
                bits = bits[place < np.repeat(row_width, 8 * row_stride)]
            ends = np.concatenate([[0], np.cumsum(row_width)]).astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(starts), pa.ListArray.from_arrays(pa.array(ends), pa.array(bits)), mask=pa.array(gone[a:b]))

        none = pa.array([], pa.list_(pa.list_(pa.bool_())))
        return pa.concat_arrays([none, *[part(a, b) for a, b in _runs(8 * sizes, STEP_PIXELS)]])

    return unpack(data, width)


def with_pixels(data: Column, width: Column, pixels: Column, value: Column) -> Column:
    """Pixels, an array of [x, y], set or cleared (B3); those outside are left out."""

    @pandas_udf("binary")
    def put(d: pd.Series, w: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, n, points, on):
            step = -(-n // 8)
            out = np.frombuffer(b, np.uint8).copy()
            for x, y in points:
                if 0 <= x < n and 0 <= y < len(out) // step:
                    bit = np.uint8(1 << (x % 8))
                    k = y * step + x // 8
                    out[k] = out[k] | bit if on else out[k] & ~bit
            return out.tobytes()

        return pd.Series([None if b is None else one(b, int(n), q, on) for b, n, q, on in zip(d, w, p, v, strict=True)])

    return put(data, width, pixels, value)


def continuous_bit(x: Column, y: Column, width: Column) -> Column:
    """Bit number in the layout without row padding; equal to ours only if width is a multiple of 8."""
    return y * width + x


def decoded(text: Column, width: Column, height: Column) -> Column:
    """Base64 to bytes, null unless the length is exact (F8)."""
    raw = F.unbase64(text)
    return F.when(F.octet_length(raw) == expected_size(width, height), raw)


def brush_words(strokes: DataFrame, patch: int = PATCH) -> DataFrame:
    """Pixels painted by round brushes (id, cx, cy, radius: whole pixels) as words of 32: (id, patch_x, patch_y, at, word).

    dx * dx + dy * dy <= r * r. ``at`` numbers the words of a patch row by row, the lowest bit leftmost. A brush is cut into
    rows, a row into words, and words of one place are joined, so it costs a few rows of the table for each row of pixels.
    """
    c, r = F.col, F.floor("radius").cast("long")
    half = F.floor(F.sqrt(c("radius") * c("radius") - c("_dy") * c("_dy"))).cast("long")
    p = spread(strokes).where("radius >= 0").withColumn("_dy", F.explode(F.sequence(-r, r))).withColumns({"py": c("cy") + c("_dy"), "_x0": F.greatest(F.lit(0), c("cx") - half), "_x1": c("cx") + half})
    p = p.where("py >= 0 and _x1 >= _x0").withColumn("_w", F.explode(F.sequence(F.floor(c("_x0") / WORD), F.floor(c("_x1") / WORD))))
    low, high = F.greatest(c("_x0") - c("_w") * WORD, F.lit(0)), F.least(c("_x1") - c("_w") * WORD, F.lit(WORD - 1))
    # Ones from bit low to bit high.
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (high + 1).cast("int")) - F.call_function("shiftleft", F.lit(1).cast("long"), low.cast("int"))
    cut = lambda v: F.floor(v / patch).cast("long")
    at = (F.pmod("py", F.lit(patch)) * (patch // WORD) + F.pmod(c("_w"), F.lit(patch // WORD))).cast("int")
    words = p.select("id", cut(c("_w") * WORD).alias("patch_x"), cut(c("py")).alias("patch_y"), at.alias("at"), word.alias("word"))
    return words.groupBy("id", "patch_x", "patch_y", "at").agg(F.bit_or("word").alias("word"))


def brush(strokes: DataFrame, patch: int = PATCH) -> DataFrame:
    """Pixels of ``brush_words`` as (id, patch_x, patch_y, x, y), each once; x and y count from the patch's corner."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit(F.col("word"), k) == 1)).alias("_bit")
    wide, at = patch // WORD, F.col("at")
    return brush_words(strokes, patch).select("id", "patch_x", "patch_y", "at", bit).select("id", "patch_x", "patch_y", (at % wide * WORD + F.col("_bit")).alias("x"), F.floor(at / wide).cast("int").alias("y"))


def painted(pixels: DataFrame, patch: int = PATCH) -> DataFrame:
    """Pixels of ``brush`` as packed patches (id, patch_x, patch_y, data)."""
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x", F.lit(WORD)).cast("int"))).alias("word")
    return patches(pixels.groupBy("id", "patch_x", "patch_y", (F.col("y") * (patch // WORD) + F.floor(F.col("x") / WORD)).cast("int").alias("at")).agg(word), patch)


def patches(words: DataFrame, patch: int = PATCH) -> DataFrame:
    """Words of ``brush_words`` as packed patches (id, patch_x, patch_y, data): a patch's words, patch * patch / 32 of them at
    most, are gathered in Spark, and some patches at a time are written out."""
    kind = dict(words.dtypes)["id"]
    held = words.groupBy("id", "patch_x", "patch_y").agg(F.collect_list(F.col("at")).alias("at"), F.collect_list(F.col("word")).alias("word"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for rows in batches:
            for a in range(0, len(rows), PATCHES):
                some = rows.iloc[a : a + PATCHES]
                out = np.zeros((len(some), patch * patch // WORD), "<u4")
                out[np.repeat(np.arange(len(some)), some["at"].map(len)), np.concatenate(some["at"].tolist())] = np.concatenate(some["word"].tolist())
                yield some[["id", "patch_x", "patch_y"]].assign(data=[row.tobytes() for row in out])

    return held.mapInPandas(fill, f"id {kind}, patch_x long, patch_y long, data binary")


def stroke_points(x0: Column, y0: Column, x1: Column, y1: Column, radius: Column) -> Column:
    """Points between two pointer places, a step of max(1, 0.3 r) apart."""
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(x1 - x0, y1 - y0) / F.greatest(F.lit(1.0), radius * 0.3)).cast("int"))
    return F.transform(F.sequence(F.lit(0), steps), lambda k: F.array(x0 + (x1 - x0) * k / steps, y0 + (y1 - y0) * k / steps))


def coloured(data: Column, width: Column, rgb: tuple[int, int, int], opacity: float) -> Column:
    """Packed mask to RGBA bytes in a layer's colour."""

    @pandas_udf("binary")
    def colour(d: pd.Series, w: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, n):
            bits = np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, -(-n // 8)), axis=1, bitorder="little")[:, :n]
            return (bits[..., None] * np.array([*rgb, round(opacity * 255)], np.uint8)).tobytes()

        return pd.Series([None if b is None else one(b, int(n)) for b, n in zip(d, w, strict=True)])

    return colour(data, width)
