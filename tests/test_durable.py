"""Consumers, ledgers and sinks under failure: nothing is lost, nothing is done twice, nothing half-written stays."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tilewright.sources import journal, ledger, store, tile_sink
from tilewright.sources.objects import consume


def messages(spark, numbers):
    return spark.createDataFrame([(f"progress.{n % 3}.x" if n % 2 else f"miss.{n}", str(n), f"p{n}") for n in numbers], journal.MESSAGE)


def acked(path, name="worker"):
    f = path / "_acknowledged" / f"{name}.json"
    return json.loads(f.read_text())["segments"] if f.exists() else None


def pull(spark, path, handle, checkpoint, **options):
    journal.register(spark)
    stream = spark.readStream.format("journal").option("path", str(path)).option("consumer", "worker").options(**options).load()
    return consume(stream, handle, str(checkpoint), available_now=True)


def test_a_failing_handler_gets_its_batch_again(spark, tmp_path):
    path = tmp_path / "journal"
    journal.publish(messages(spark, range(5)), str(path), 0)
    seen, fail = [], [True]

    def handle(batch, number):
        got = sorted(int(r.message_id) for r in batch.collect())
        if fail[0]:
            raise RuntimeError("handler")
        seen.extend(got)

    with pytest.raises(Exception, match="handler"):
        pull(spark, path, handle, tmp_path / "cp").awaitTermination(60)
    assert seen == [] and not acked(path)  # not acknowledged early
    fail[0] = False
    pull(spark, path, handle, tmp_path / "cp").awaitTermination(60)
    assert seen == [0, 1, 2, 3, 4]
    journal.publish(messages(spark, range(5, 8)), str(path), 1)
    journal.publish(messages(spark, [99]), str(path), 3)  # segment 2 is not there yet
    pull(spark, path, handle, tmp_path / "cp").awaitTermination(60)
    assert seen == [0, 1, 2, 3, 4, 5, 6, 7]
    assert acked(path) in (1, 2)  # the last batch may be acknowledged with the next one


def test_a_lost_checkpoint_goes_on_after_what_was_acknowledged(spark, tmp_path):
    path = tmp_path / "journal"
    for n in range(3):
        journal.publish(messages(spark, [n]), str(path), n)
        pull(spark, path, lambda batch, _: batch.collect(), tmp_path / "cp").awaitTermination(60)
    done = acked(path)
    assert done >= 2
    seen = []
    pull(spark, path, lambda batch, _: seen.extend(int(r.message_id) for r in batch.collect()), tmp_path / "other").awaitTermination(60)
    assert sorted(seen) == list(range(done, 3))


@pytest.mark.parametrize("subject, fits", [("progress.*.x", r"progress\.\d\.x"), ("miss.>", r"miss\..*"), (">", ".*"), ("progress.1", "none")])
def test_subjects_with_wildcards(spark, tmp_path, subject, fits):
    path, seen = tmp_path / "journal", []
    journal.publish(messages(spark, range(10)), str(path), 0)
    pull(spark, path, lambda batch, _: seen.extend(r.subject for r in batch.collect()), tmp_path / "cp", subject=subject).awaitTermination(60)
    assert sorted(seen) == sorted(r.subject for r in messages(spark, range(10)).collect() if re.fullmatch(fits, r.subject))


@pytest.mark.parametrize("fails_after", ["publish", "mark"])
def test_each_key_is_dispatched_once(spark, tmp_path, fails_after):
    """The second batch fails between publishing and marking, or after both; it comes again."""
    source, path, book = tmp_path / "in", str(tmp_path / "journal"), str(tmp_path / "ledger")
    fail = [True]

    def publish(rows, number):
        journal.publish(rows.select(F.lit("slide").alias("subject"), F.col("key").alias("message_id"), F.col("key").alias("payload")), path, number)
        if number == 1 and fails_after == "publish" and fail[0]:
            fail[0] = False
            raise RuntimeError("between")

    handle = ledger.dispatching(book, publish)

    def handle_and_fail(batch, number):
        handle(batch, number)
        if number == 1 and fails_after == "mark" and fail[0]:
            fail[0] = False
            raise RuntimeError("after")

    def go():
        stream = spark.readStream.schema("key string").option("recursiveFileLookup", "true").parquet(str(source))
        consume(stream, handle_and_fail, str(tmp_path / "cp"), available_now=True).awaitTermination(60)

    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1)
    rows("a", "b", "a", None).write.parquet(str(source / "0"))
    go()
    rows("b", "c", "d").write.parquet(str(source / "1"))
    with pytest.raises(Exception, match="between|after"):
        go()
    go()
    rows("d", "e").write.parquet(str(source / "2"))
    go()
    got = sorted((r.segment, r.message_id) for r in spark.read.option("basePath", path).parquet(f"{path}/segment=*").collect())
    assert got == [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "e")]
    assert sorted(r.key for r in ledger.marked(spark, book).collect()) == ["a", "b", "c", "d", "e"]


# --- sinks


def tiles(spark, n, parts=4):
    k = F.col("id")
    return spark.range(n).select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("id"), (k % 2).cast("int").alias("level"), k.cast("int").alias("x"), F.lit(0).alias("y"), F.concat(F.lit("tile "), k.cast("string")).cast("binary").alias("data")).repartition(parts, "x")


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith(".") and "_jobs" not in p.parts)


def jobs(root):
    return [json.loads(p.read_text()) for p in sorted((root / "_jobs").glob("*.json"), key=lambda p: p.stat().st_mtime_ns)]


def write(df, root):
    tile_sink.register(df.sparkSession)
    df.write.format("tile_files").mode("append").option("path", str(root)).option("wait", "0.001").save()


def test_tiles_are_written_once(spark, tmp_path):
    root = tmp_path / "t"
    write(tiles(spark, 20), root)
    assert len(files(root)) == 20 and (root / "s1" / "0" / "4_0.webp").read_bytes() == b"tile 4"
    write(tiles(spark, 20), root)
    changed = tiles(spark, 20).withColumn("data", F.when(F.col("x") == 4, F.lit("new").cast("binary")).otherwise(F.col("data")))
    write(changed, root)
    assert [(j["written"], j["skipped"]) for j in jobs(root)] == [(20, 0), (0, 20), (1, 19)]
    assert (root / "s1" / "0" / "4_0.webp").read_bytes() == b"new" and not list(root.rglob("*.tmp")) and not list((root / "_pending").iterdir())


def test_a_task_that_dies_half_way_leaves_no_tile(spark, tmp_path):
    root = tmp_path / "t"

    @F.udf("binary")
    def fails_late(x):
        if x == 37:
            raise ValueError("killed")
        return b"tile"

    with pytest.raises(Exception, match="killed"):
        write(tiles(spark, 40, 1).orderBy("x").coalesce(1).withColumn("data", fails_late("x")), root)
    assert files(root) == [] and not [p for p in root.rglob("*") if p.is_file()]
    write(tiles(spark, 40), root)
    assert len(files(root)) == 40
    with pytest.raises(Exception, match="append"):
        tiles(spark, 1).write.format("tile_files").mode("overwrite").option("path", str(root)).save()


def test_a_stream_of_tiles_repeats_nothing(spark, tmp_path):
    tile_sink.register(spark)
    tiles(spark, 12).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "a", "b"):  # a checkpoint that is lost replays all batches
        stream = spark.readStream.schema(tile_sink.TILE).parquet(str(tmp_path / "in"))
        stream.writeStream.format("tile_files").option("path", str(tmp_path / "t")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(60)
    assert len(files(tmp_path / "t")) == 12
    assert jobs(tmp_path / "t")[-1]["written"] == 0


def test_writes_are_tried_again(monkeypatch):
    waits = []
    monkeypatch.setattr(store.time, "sleep", waits.append)
    calls = iter([OSError("a"), OSError("b"), "done"])

    def f():
        got = next(calls)
        if isinstance(got, OSError):
            raise got
        return got

    assert store.retried(f) == ("done", 3) and 1.8 <= waits[0] <= 2 and 3.6 <= waits[1] <= 4
    calls = iter([OSError(str(n)) for n in range(9)])
    with pytest.raises(OSError, match="4"):
        store.retried(f)
    assert waits[-1] <= 20 and len(waits) == 6


def test_downloads_are_whole_and_verified(spark, tmp_path):
    import hashlib

    source, target = tmp_path / "from", tmp_path / "to"
    source.mkdir()
    target.mkdir()
    for name, data in (("a", b"x" * 100_000), ("b", b"bad"), ("c", b"there"), ("d", b"")):
        (source / name).write_bytes(data)
    (target / "c").write_bytes(b"there")
    (target / "a").write_bytes(b"part")
    md5 = lambda b: hashlib.md5(b).hexdigest()
    rows = [(f"file://{source}/a", "a", 100_000, md5(b"x" * 100_000)), (f"file://{source}/b", "b", 3, md5(b"good")), (f"file://{source}/c", "c", 5, "not compared"), (f"file://{source}/d", "d", None, None), (f"file://{source}/none", "e", 1, None)]
    got = tile_sink.fetched(spark.createDataFrame(rows, "source string, name string, size long, md5 string"), f"file://{target}", wait=0.001)
    assert sorted(map(tuple, got.collect())) == [("a", "written", 100_000, 1), ("b", "mismatch", 3, 1), ("c", "present", 5, 1), ("d", "written", 0, 1), ("e", "failed", 0, None)]
    assert sorted(p.name for p in target.iterdir()) == ["a", "c", "d"] and (target / "a").stat().st_size == 100_000
    again = tile_sink.fetched(spark.createDataFrame(rows[:1], "source string, name string, size long, md5 string"), f"file://{target}")
    assert [r.status for r in again.collect()] == ["present"]
