"""Places in the order of a key's rows, without a key's rows in one task.

A key's rows are dealt into cells, ranges of the order's columns. A cell of too many rows is cut into ``CUTS`` equal parts of
the first column in which its rows differ, until none is left that is too large or can be cut. Only counts and sums of
cells are summed in windows; a row's place is its cell's start plus its place in the cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import stage

#: Rows of a cell at most, parts that one is cut into, and cells to cut up to which they are broadcast.
CELL_ROWS, CUTS, BROADCAST_CELLS = 50_000, 256, 100_000


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(right[f"_r_{c}"])
    return out


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, upto: int | None = None, running: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``name``, the place from 1 of each row among those of its key by the columns ``order``, nulls first, NaN last.

    ``order``: columns of numbers. Rows equal in all of them stand in one cell and in any order among themselves.
    ``upto`` keeps rows with places up to it, and reads only the cells that have them. ``running`` = (column, name) adds the
    column's sum over the rows before, null counting as 0.
    """
    keys, cell = list(keys), [*keys, "_cell"]
    sums = [F.sum(F.coalesce(F.col(running[0]), F.lit(0))).alias("_sum")] if running else []
    rows, before = df.withColumn("_cell", F.lit("")), None
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    while True:
        ends = [e for i, c in enumerate(order) for e in (F.min(number(c)).alias(f"_low{i}"), F.max(number(c)).alias(f"_high{i}"), F.count(number(c)).alias(f"_held{i}"), F.count(c).alias(f"_there{i}"))]
        cells = stage(rows.groupBy(*cell).agg(F.count("*").alias("_rows"), *sums, *ends), "cells")
        # Numbers that differ, or numbers, nulls and NaN side by side.
        part_of = lambda a, b: (F.col(a) > 0) & (F.col(a) < F.col(b))
        differs = [F.coalesce(F.col(f"_low{i}") < F.col(f"_high{i}"), F.lit(False)) | part_of(f"_held{i}", "_rows") | part_of(f"_there{i}", "_rows") for i in range(len(order))]
        by = F.coalesce(*[F.when(d, F.lit(i)) for i, d in enumerate(differs)])
        full = cells.where((F.col("_rows") > CELL_ROWS) & by.isNotNull()).withColumn("_by", by)
        n, left = full.agg(F.count("*"), F.sum("_rows")).first()
        if not n or (n, left) == before:  # all small, or no cut helps, as with infinite ends
            break
        before = n, left
        full = full.select(*[F.col(c).alias(f"_r_{c}") for c in cell], "_by", *[F.col(f"_{e}{i}") for i in range(len(order)) for e in ("low", "high")])

        def part(i: int, c: str) -> Column:
            share = (F.col(c) - F.col(f"_low{i}")) / F.greatest(F.col(f"_high{i}") - F.col(f"_low{i}"), F.lit(1e-300))
            place = F.when(F.isnan(share.cast("double")), F.lit(0)).otherwise(F.least(F.floor(share * CUTS), F.lit(CUTS - 1)))
            return F.when(F.col(c).isNull(), F.lit(0)).when(F.isnan(F.col(c).cast("double")), F.lit(CUTS + 1)).otherwise(place.cast("int") + 1)

        digit = F.coalesce(*[F.when(F.col("_by") == i, part(i, c)) for i, c in enumerate(order)])
        met = rows.join(F.broadcast(full) if n <= BROADCAST_CELLS else full, _same(rows, full, cell), "left")
        rows = met.select(*df.columns, F.when(F.col("_by").isNull(), F.col("_cell")).otherwise(F.concat("_cell", F.lpad(F.hex(digit), 3, "0"))).alias("_cell"))
    cells_before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*[F.col(c).alias(f"_r_{c}") for c in cell], F.coalesce(F.sum("_rows").over(cells_before), F.lit(0)).alias("_start"), *([F.coalesce(F.sum("_sum").over(cells_before), F.lit(0)).alias("_before")] if running else []))
    if upto is not None:
        starts = starts.where(F.col("_start") < upto)
    placed = rows.join(starts, _same(rows, starts, cell)).drop(*[f"_r_{c}" for c in cell])
    w = Window.partitionBy(*cell).orderBy(*order)
    out = placed.withColumn(name, F.row_number().over(w) + F.col("_start"))
    if running:
        inside = F.sum(F.coalesce(F.col(running[0]), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(running[1], F.coalesce(inside, F.lit(0)) + F.col("_before"))
    if upto is not None:
        out = out.where(F.col(name) <= upto)
    return out.select(*df.columns, name, *([running[1]] if running else []))
