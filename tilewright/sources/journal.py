"""A journal of messages on shared storage, and a durable pull consumer of it as a streaming data source.

A journal is a folder of segments, ``segment=0``, ``segment=1`` and so on, each a Parquet table of (subject, message_id,
payload) that counts once it is whole. Publishing a segment again replaces it, so a producer that numbers its segments by
its batches publishes each message once, however often a batch is repeated.

``spark.readStream.format("journal")`` reads it for a named consumer. An offset is a number of segments. Spark commits an
offset when the batch up to it was handled: that is the acknowledgement, and it is written down beside the journal. A
query that fails gets the batch again; a consumer whose checkpoint is lost goes on after what it has acknowledged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tilewright.sources.store import exists, opened, put

MESSAGE = "subject string, message_id string, payload string"


def publish(messages: DataFrame, path: str, segment: int) -> None:
    """Write one segment of (subject, message_id, payload), in place of the same segment if it is there."""
    messages.select("subject", "message_id", "payload").write.mode("overwrite").parquet(f"{path}/segment={segment}")


def pattern(subject: str) -> re.Pattern[str]:
    """A subject with wildcards: ``*`` is one part between dots, ``>`` all parts from there on."""
    parts = [r"[^.]+" if p == "*" else r".+" if p == ">" else re.escape(p) for p in subject.split(".")]
    return re.compile(r"\.".join(parts))


class Journal(DataSource):
    """Options: path, consumer (a name; what it acknowledged is kept under it), subject (all, if not given)."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return f"segment long, {MESSAGE}"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Consumer(self.options["path"].rstrip("/"), self.options["consumer"], self.options.get("subject", ">"))


class _File(InputPartition):
    def __init__(self, segment: int, path: str):
        self.segment, self.path = segment, path


class _Consumer(DataSourceStreamReader):
    def __init__(self, path: str, consumer: str, subject: str):
        self.path, self.consumer, self.subject = path, consumer, subject

    def _acked(self) -> str:
        return f"{opened(self.path)[1]}/_acknowledged/{self.consumer}.json"

    def initialOffset(self) -> dict:
        at, _ = opened(self.path)
        if not exists(at, self._acked()):
            return {"segments": 0}
        with at.open_input_stream(self._acked()) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        at, root = opened(self.path)
        found = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
        there = {int(i.base_name.removeprefix("segment=")) for i in found if i.base_name.startswith("segment=") and exists(at, f"{i.path}/_SUCCESS")}
        n = 0
        while n in there:  # a gap is a segment that is still being written
            n += 1
        return {"segments": n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        at, root = opened(self.path)
        files = lambda n: at.get_file_info(fs.FileSelector(f"{root}/segment={n}"))
        return [_File(n, i.path) for n in range(start["segments"], end["segments"]) for i in files(n) if i.base_name.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        at, _ = opened(self.path)
        wanted = pattern(self.subject)
        with at.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["subject", "message_id", "payload"]):
                keep = pa.array([s is not None and wanted.fullmatch(s) is not None for s in batch.column(0).to_pylist()], pa.bool_())
                b = batch.filter(keep)
                yield pa.RecordBatch.from_arrays([pa.array([partition.segment] * b.num_rows, pa.int64()), *b.columns], ["segment", "subject", "message_id", "payload"])

    def commit(self, end: dict) -> None:
        put(opened(self.path)[0], self._acked(), json.dumps(end).encode())


def register(spark) -> None:
    spark.dataSource.register(Journal)
