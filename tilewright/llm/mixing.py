"""Mixing sources to target weights by systematic sampling.

Targets: sources share ``share`` of all words by weight, none above ``most`` times its own; the excess is reshared by
weight. That is target = min(most * size, rate * weight) with one rate, found from sums over the sources in the order
in which they saturate. Sampling: within a source, each document expects target / source size copies. The running sum
of expected copies, plus one random offset, crosses integers; a document is taken once for each integer it crosses.
Documents stand in order of size (to a 32nd of a power of two), then of a hash, so that words taken come near the target.

The running sum is exact and needs no large window: a source is dealt into cells (size step, prefix of the order's key),
cells are counted, and a document's place is its cell's start plus its row number in the cell. A cell of too many rows is
dealt out again by more digits of the key, past those that its rows share, until none is left; the key ends in a number of
its own for each row, so neither a null id nor one that repeats makes a large cell.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.session import stage

#: Rows of a cell at most. Cells to deal out again up to this many are broadcast, more are joined by a shuffle.
CELL_ROWS, BROADCAST_CELLS = 1_000, 200_000


def n_words(text: Column) -> Column:
    """Number of stretches without space or 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def size_step(size: Column) -> Column:
    """The size's leading six bits and its length in bits, as one number that grows with the size."""
    bits = F.length(F.bin(size))
    return bits.cast("long") * 64 + F.expr("shiftright(size, greatest(length(bin(size)) - 6, 0))")


def offset_of(seed: int) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def targets(per: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source (key, source, source_size): the same with its target.

    Sources are numbered by code point, null last; the windows here hold one row per source. Sources saturate in order
    of size over weight. Leaving out the saturated ones raises the rate of the rest until the first that stays below
    its limit, and lowers it after that, so the rate sought is the largest. A source without words has target 0.
    """
    named, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ordered = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    rate = left / F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return per.withColumn("w", w).withColumn("rate", rate).withColumn("level", F.max("rate").over(everything)).select("key", "source_size", F.least(cap, F.col("level") * F.col("w")).alias("target"))


def dealt(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, source, step, order, size) with their cell, and (source, key, step, cell, rows, words) of every cell.

    ``sized`` is a staged table. Cells start as whole steps of a source. One of more than ``CELL_ROWS`` rows is cut by so
    many digits of ``order`` as would do if they were even, counted from the first in which its rows differ.
    """
    cell = ["key", "step", "cell"]
    rows = sized.withColumn("cell", F.lit(""))
    while True:
        cells = stage(rows.groupBy("source", *cell).agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.min("order").alias("low"), F.max("order").alias("high")), "mix-cells")
        shared = F.expr("aggregate(sequence(1, length(low)), 0, (n, i) -> if(left(low, i) = left(high, i), i, n))")
        more = F.greatest(F.ceil(F.log(F.col("rows") / F.lit(CELL_ROWS)) / F.log(F.lit(16.0))), F.lit(1))
        full = cells.where(F.col("rows") > CELL_ROWS).select(*cell, (shared + more).cast("int").alias("digits"))
        n = full.count()
        if not n:
            return rows, cells.drop("low", "high")
        rows = rows.join(F.broadcast(full) if n <= BROADCAST_CELLS else full, cell, "left").withColumn("cell", F.coalesce(F.expr("left(`order`, digits)"), "cell")).drop("digits")


def mix(docs: DataFrame, keep: Sequence[str], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, source) with the copies that the mix takes of it.

    Returns row (a struct of the columns ``keep``), size, source_size, target (of its source) and copies (0 to
    ``most``, rounded up). Null or empty texts have size 0; they may be copied but add no words. A null source is a
    source of its own. Rows equal in doc_id and size may stand for each other; others are ordered by their values
    alone, so reruns agree. An empty table gives an empty result.
    """
    hexed = lambda v: F.lpad(F.hex(v), 16, "0")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
        "source",
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("hash"),
        F.xxhash64("text").alias("same"),
    )
    sized = sized.select("row", "key", "source", "size", size_step(F.col("size")).alias("step"), F.concat("hash", hexed(F.col("size")), hexed(F.col("same")), hexed(F.monotonically_increasing_id())).alias("order"))
    rows, cells = dealt(stage(sized, "mix-sized"))
    cell = ["key", "step", "cell"]
    in_step = Window.partitionBy("key", "step").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("key").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = cells.groupBy("key", "step").agg(F.sum("rows").alias("step_rows")).withColumn("step_start", F.coalesce(F.sum("step_rows").over(in_source), F.lit(0)))
    per = targets(cells.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = (
        cells.withColumn("in_step", F.coalesce(F.sum("rows").over(in_step), F.lit(0)))
        .join(steps, ["key", "step"])
        .join(per, "key")
        .select(*cell, "source_size", "target", (F.col("step_start") + F.col("in_step")).alias("start"))
    )
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("order")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda k: F.floor(k * each + F.lit(offset_of(seed)))
    at = F.col("start") + F.col("place")
    return placed.join(starts, cell).select("row", "size", "source_size", "target", (upto(at) - upto(at - 1)).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with all its columns."""
    mixed = mix(docs, docs.columns)
    return mixed.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sql(documents: str = "documents", seed: int = 7) -> str:
    """DuckDB SQL for the rows of ``query`` over a table of documents."""
    return f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {documents}
), p as (
  select source, sum(size)::bigint as source_size, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w
  from d group by source
), q as (
  select *, ((sum(source_size) over ())::double * 1.5::double
            - coalesce(sum(source_size) over (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double * 2::double)
           / sum(w) over (order by source_size::double / w, source nulls last rows between current row and unbounded following) as rate
  from p
), t as (
  select source, source_size, least(source_size::double * 2::double, max(rate) over () * w) as target from q
), o as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size::double else 0::double end as each,
         row_number() over (partition by d.source order by length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) desc,
                            md5('{seed}:' || coalesce(doc_id::varchar, '')), doc_id nulls last, size) as k
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (floor(k * each + {offset_of(seed)!r}::double) - floor((k - 1) * each + {offset_of(seed)!r}::double))::bigint * size as taken
from o
"""
