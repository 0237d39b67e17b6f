"""Rate limits, gates, retries and throttles over keyed events, in batch and as streams with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

#: Burst of 20 in 5 s, 200 in 60 s, 512 arrivals remembered (ST2).
BURST, BURST_MS, LONG, LONG_MS, REMEMBERED = 20, 5_000, 200, 60_000, 512


def rate_limited(events: DataFrame, key: str, at: str, order: str, burst: int = BURST, burst_ms: int = BURST_MS, long: int = LONG, long_ms: int = LONG_MS, remembered: int = REMEMBERED) -> DataFrame:
    """Adds burst_count, long_count and denied (ST1): arrivals of the key within either window, itself and denied ones too.

    ``at``: milliseconds. Counts come from two ordered windows, so a key is never joined with itself; of the arrivals
    only the last ``remembered`` count.
    """
    w = Window.partitionBy(key)
    nth = F.row_number().over(w.orderBy(at, order))
    older = lambda ms: F.count("*").over(w.orderBy(at).rangeBetween(Window.unboundedPreceding, -ms - 1))
    counted = events.withColumns({"burst_count": F.least(F.lit(remembered), nth - older(burst_ms)), "long_count": F.least(F.lit(remembered), nth - older(long_ms))})
    return counted.withColumn("denied", (F.col("burst_count") > burst) | (F.col("long_count") > long))


def rate_limit_stream(events: DataFrame, key: str, at: str, order: str, burst: int = BURST, burst_ms: int = BURST_MS, long: int = LONG, long_ms: int = LONG_MS, remembered: int = REMEMBERED) -> DataFrame:
    """The same over a stream (ST1): state is the key's last arrivals, dropped after the long window without any."""
    kinds = dict(events.dtypes)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, order])
        out = []
        for now, nth in zip(rows[at].tolist(), rows[order].tolist(), strict=True):
            seen = [*seen, now][-remembered:]
            b, n = (sum(t >= now - ms for t in seen) for ms in (burst_ms, long_ms))
            out.append((keys[0], nth, now, b, n, b > burst or n > long))
        state.update((seen,))
        state.setTimeoutDuration(long_ms)
        yield pd.DataFrame(out, columns=[key, order, at, "burst_count", "long_count", "denied"])

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {at} {kinds[at]}, burst_count long, long_count long, denied boolean"
    return events.groupBy(key).applyInPandasWithState(step, out, "seen array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gated(events: DataFrame, keys: list[str], at: str, order: str, interval: int) -> DataFrame:
    """Adds ``passed``: at least ``interval`` since the last event that passed (ST3, ST5, ST15).

    A pause of ``interval`` starts a burst in which nothing before matters, so bursts, not keys, are dealt to tasks.
    Each task reads its bursts in order, batch by batch. Events without a time do not pass.
    """
    w = Window.partitionBy(*keys).orderBy(at, order)
    pause = F.coalesce(F.col(at) - F.lag(at).over(w) >= interval, F.lit(True))
    bursts = events.withColumn("_first", pause).withColumn("_burst", F.sum(F.col("_first").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    columns = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            out = []
            for t, first in zip(batch.column(at).to_pylist(), batch.column("_first").to_pylist(), strict=True):
                ok = t is not None and (first or t - last >= interval)
                last = t if ok else last
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.bool_())], [*columns, "passed"])

    dealt = bursts.repartition(*keys, "_burst").sortWithinPartitions(*keys, "_burst", at, order)
    return dealt.mapInArrow(run, StructType([*events.schema.fields, StructField("passed", BooleanType())]))


def gate_stream(events: DataFrame, key: str, at: str, order: str, interval: int) -> DataFrame:
    """The same over a stream: state is the time of the last event that passed and their number (ST3, ST5)."""
    kinds = dict(events.dtypes)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, count = state.get if state.exists else (None, 0)
        rows, out = pd.concat(list(batches)).sort_values([at, order]), []
        for t, nth in zip(rows[at].tolist(), rows[order].tolist(), strict=True):
            ok = last is None or t - last >= interval
            last, count = (t, count + 1) if ok else (last, count)
            out.append((keys[0], nth, t, ok, count))
        state.update((last, count))
        state.setTimeoutDuration(max(interval, 1000))
        yield pd.DataFrame(out, columns=[key, order, at, "passed", "count"])

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {at} {kinds[at]}, passed boolean, count long"
    return events.groupBy(key).applyInPandasWithState(step, out, "last long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def throttled_progress(steps: DataFrame, key: str, done: str, at: str, every: int = 300, least_ms: int = 3_000) -> DataFrame:
    """Progress reports of a batch (ST12): rows that pass a multiple of ``every``, ``least_ms`` after the last report."""
    w = Window.partitionBy(key).orderBy(done)
    crossed = F.floor(F.col(done) / F.lit(every)) > F.floor(F.coalesce(F.lag(done).over(w), F.lit(0)) / F.lit(every))
    return gated(steps.where(F.lit(True)).withColumn("_crossed", crossed).where("_crossed").drop("_crossed"), [key], at, done, least_ms).where("passed").drop("passed")


def distinct_messages(events: DataFrame, message_id: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Each message id once, in batch, or in a stream within the watermark (ST14, S8)."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([message_id]) if events.isStreaming else events.dropDuplicates([message_id])


def retry_delay(attempt: Column, jitter: Column | None = None) -> Column:
    """Milliseconds before retry ``attempt`` (from 0): 3 s doubled each time, and up to 200 ms (ST9)."""
    return (F.lit(3000) * F.pow(F.lit(2.0), attempt)).cast("long") + (F.lit(0) if jitter is None else (jitter * 200).cast("long"))


def retry_schedule(pending: DataFrame, first: str, most: int = 10, initial: int = 1_100) -> DataFrame:
    """One row per retry of each pending tile with the time of it (ST9): 1.1 s, then the delays, ``most`` in all."""
    rows = pending.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    waited = F.when(F.col("attempt") == 0, 0).otherwise((F.pow(F.lit(2.0), F.col("attempt")) - 1) * 3000).cast("long")
    return rows.withColumn("retry_at", F.col(first) + initial + waited)


def reconnect_delay(attempt: Column, base: int = 1_000) -> Column:
    """base * min(attempt, 10) (ST10)."""
    return F.least(attempt, F.lit(10)) * base


def full_jitter(attempt: Column, base: int, cap: int, uniform: Column) -> Column:
    """Uniform between 0 and min(cap, base * 2**attempt) (ST11)."""
    return uniform * F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt))


def rolling_rate(frames: DataFrame, key: str, order: str, took: str, last: int = 30) -> DataFrame:
    """Mean of the last 30 frame times, and frames a second (A14): infinite where these frames took no time."""
    mean = F.avg(took).over(Window.partitionBy(key).orderBy(order).rowsBetween(-(last - 1), 0))
    return frames.withColumn("mean_ms", mean).withColumn("fps", F.when(F.col("mean_ms") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1000.0), F.col("mean_ms"))))


def latency_histogram(df: DataFrame, key: str, value: str, limits: list[float]) -> DataFrame:
    """Cumulative counts up to each limit (A15): one row per key and limit."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(limits)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(limits)])
    return counts.select(key, F.explode(pairs).alias("b")).select(key, "b.le", "b.n")


def velocity(samples: DataFrame, key: str, at: str, dx: str, dy: str, now: Column, most_age: int = 100) -> DataFrame:
    """Pixels a second over recent samples (A16): sums over positive gaps; null under two samples."""
    w = Window.partitionBy(key).orderBy(at)
    recent = samples.where(now - F.col(at) <= most_age).withColumn("_dt", F.col(at) - F.lag(at).over(w))
    gap = F.col("_dt") > 0
    total = lambda c: F.sum(F.when(gap, F.col(c)))
    return recent.groupBy(key).agg((total(dx) / total("_dt") * 1000).alias("vx"), (total(dy) / total("_dt") * 1000).alias("vy"))
