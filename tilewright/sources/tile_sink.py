"""A sink of tiles as files, for batches and streams, and downloads of verified files: whole files or none.

``df.write.format("tile_files")`` and ``stream.writeStream.format("tile_files")`` write <root>/<id>/<level>/<x>_<y>.webp.
A task writes all its tiles under a folder of its own first and renames them once it has them all, so a task that dies
half-way leaves no tile, and what it wrote is removed when the job is aborted. A driver that dies leaves a folder under
``_pending`` that readers of tiles never look into. A tile that is there with the same bytes is skipped, so a repeated batch
writes nothing. Commit messages hold counts, not names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from tilewright.session import stage
from tilewright.sources.store import exists, opened, put, retried, size_of

TILE = "id string, level int, x int, y int, data binary"
#: Fixed value: bytes between flushes of a download.
FLUSH = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    written: int
    skipped: int
    bytes: int
    tries: int


class TileFiles(DataSource):
    """Options: path, wait (seconds that waits between tries start from, 1)."""

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return TILE

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("tiles are added to a folder, not in place of it: use mode append")
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


def _same(at: fs.FileSystem, path: str, data: bytes) -> bool:
    if size_of(at, path) != len(data):
        return False
    with at.open_input_stream(path) as f:
        return f.read() == data


class _Tiles:
    """What both writers do. All jobs of a folder share ``_pending``, with a folder for each."""

    def __init__(self, options: dict):
        self.path, self.wait = options["path"].rstrip("/"), float(options.get("wait", 1))
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        at, root = opened(self.path)
        mine = f"{root}/_pending/{self.job}/{uuid.uuid4().hex}"
        pending, skipped, total, tries = [], 0, 0, 0
        for n, row in enumerate(rows):
            path, data = f"{root}/{row.id}/{row.level}/{row.x}_{row.y}.webp", bytes(row.data)
            if _same(at, path, data):
                skipped += 1
                continue
            _, used = retried(lambda to=f"{mine}/{n}", data=data: put(at, to, data), self.wait)
            pending.append((f"{mine}/{n}", path))
            total, tries = total + len(data), tries + used
        for folder in {path.rpartition("/")[0] for _, path in pending}:
            at.create_dir(folder, recursive=True)
        for temporary, path in pending:
            retried(lambda a=temporary, b=path: at.move(a, b), self.wait)
        return Written(len(pending), skipped, total, tries)

    def _clear(self) -> None:
        at, root = opened(self.path)
        if exists(at, f"{root}/_pending/{self.job}"):
            at.delete_dir(f"{root}/_pending/{self.job}")

    def _report(self, messages: list[Written | None], name: str) -> None:
        at, root = opened(self.path)
        done = [m for m in messages if m is not None]
        counts = {k: sum(getattr(m, k) for m in done) for k in ("written", "skipped", "bytes", "tries")}
        put(at, f"{root}/_jobs/{name}.json", json.dumps(counts).encode())


class _Writer(_Tiles, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._report(messages, self.job)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class _StreamWriter(_Tiles, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._report(messages, f"batch-{batchId}")
        self._clear()

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._clear()


def register(spark) -> None:
    spark.dataSource.register(TileFiles)


def fetched(files: DataFrame, folder: str, wait: float = 1.0) -> DataFrame:
    """Files (source, name, size, md5) copied into ``folder`` (S5, S15): name, status, bytes and tries, staged.

    A file of the right size that is there is ``present`` and not read. Others are copied in pieces to a temporary name,
    their MD5 worked out on the way, and renamed if size and MD5 are those expected: ``written``, else ``mismatch``, and
    nothing is left. A null size or MD5 is not compared; without a size a file that is there is present. A source that
    cannot be read after all tries is ``failed``. Copies are spread over tasks by name.
    """

    def copy(source: str, name: str, size: int | None, md5: str | None, at: fs.FileSystem, root: str) -> tuple[str, int]:
        there = size_of(at, f"{root}/{name}")
        if there is not None and size in (None, there):
            return "present", there
        origin, path = opened(source)
        at.create_dir(root, recursive=True)
        temporary, total, digest = f"{root}/.{name}.{uuid.uuid4().hex}.tmp", 0, hashlib.md5()
        try:
            with origin.open_input_stream(path) as f, at.open_output_stream(temporary) as out:
                while piece := f.read(FLUSH):
                    out.write(piece)
                    out.flush()
                    digest.update(piece)
                    total += len(piece)
            if size not in (None, total) or md5 not in (None, digest.hexdigest()):
                return "mismatch", total
            at.move(temporary, f"{root}/{name}")
            return "written", total
        finally:
            if exists(at, temporary):
                at.delete_file(temporary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = opened(folder.rstrip("/"))
        for batch in batches:
            out = []
            for source, name, size, md5 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    (status, n), tries = retried(lambda a=source, b=name, c=size, d=md5: copy(a, b, c, d, at, root), wait)
                except OSError:
                    status, n, tries = "failed", 0, None
                out.append((name, status, n, tries))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["name", "status", "bytes", "tries"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("name", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("tries", pa.int32())]))

    chosen = files.select("source", "name", "size", "md5").repartition("name")
    return stage(chosen.mapInArrow(run, "name string, status string, bytes long, tries int"), "fetched")
