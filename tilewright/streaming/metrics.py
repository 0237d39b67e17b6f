"""Counters and histograms beside a query, kept as a table (S18): no pass of their own, a few numbers for each batch."""

from __future__ import annotations

import json
import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tilewright.sources.store import opened, put

SCHEMA = "name string, run string, batch long, metric string, value double"


def histogram(prefix: str, value: Column, buckets: Sequence[float]) -> dict[str, Column]:
    """Metrics of a histogram: how many values are at most each bound, how many there are, and their sum."""
    upto = {f"{prefix}_le_{b:g}": F.count_if(value <= b) for b in buckets}
    return upto | {f"{prefix}_count": F.count(value), f"{prefix}_sum": F.sum(value)}


def observed(df: DataFrame, name: str | Observation, metrics: Mapping[str, Column]) -> DataFrame:
    """``df`` with metrics worked out while it is read, in batch (an Observation, or a name) or as a stream (a name)."""
    return df.observe(name, *[m.alias(k) for k, m in metrics.items()])


def kept(path: str, name: str, run: str, batch: int, row: Row | Mapping) -> None:
    """Write one row of metrics down; a batch that is repeated takes its own place. A null metric counts as 0."""
    values = row.asDict() if isinstance(row, Row) else dict(row)
    lines = "".join(json.dumps({"name": name, "run": run, "batch": batch, "metric": k, "value": float(v or 0)}) + "\n" for k, v in values.items())
    at, root = opened(path)
    put(at, f"{root}/{name}-{run}-{batch}.json", lines.encode())


class MetricsTable(StreamingQueryListener):
    """A listener that keeps the observed metrics of every batch of every query."""

    def __init__(self, path: str):
        self.path, self.ended, self.news = path, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            kept(self.path, name, str(p.id), p.batchId, row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def wait_for(self, run: str, seconds: float = 60) -> None:
        """Wait until all that a run has reported is kept: its end is heard of last."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"nothing was heard of the end of {run}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """name, metric and value: counters and buckets, summed over batches."""
    return spark.read.schema(SCHEMA).json(path).groupBy("name", "metric").agg(F.sum("value").alias("value"))
