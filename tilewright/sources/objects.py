"""Reading and writing what the catalogue is made from: listings, sidecars, tile folders, verified files, results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tilewright.functions.text import has_suffix
from tilewright.sources import tile_sink

SUFFIXES = (".tif", ".tiff", ".svs")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files below a path by suffix in any case (S4): path, length, modificationTime. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").where(has_suffix(F.col("path"), *suffixes))


def with_sidecars(files: DataFrame, path: str) -> DataFrame:
    """Files with the text of <path>.json where that is valid JSON, else null."""
    spark = files.sparkSession
    side = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return with_metadata(files, side.select("path", F.decode("content", "utf-8").alias("text")))


def with_metadata(files: DataFrame, side: DataFrame) -> DataFrame:
    """Files (path, ..) with the text of the sidecar (path, text) named <path>.json, null if there is none or it is not JSON."""
    s = side.where(F.endswith("path", F.lit(".json"))).select(F.regexp_replace("path", r"\.json$", "").alias("_path"), F.col("text").alias("_text"))
    good = F.when(F.try_parse_json("_text").isNotNull(), F.col("_text"))
    return files.join(s, files["path"] == s["_path"], "left").select(*[files[c] for c in files.columns], good.alias("metadata"))


def tile_files(spark: SparkSession, root: str) -> DataFrame:
    """(id, level, x, y, path) of <root>/<id>/<level>/<x>_<y>.webp; other names are left out."""
    return tile_paths(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def tile_paths(files: DataFrame) -> DataFrame:
    """(id, level, x, y, path, length) of files (path, length) that are named like tiles."""
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/(\d+)/(\d+)_(\d+)\.webp$", k)
    return files.where(part(1) != "").select(part(1).alias("id"), part(2).cast("int").alias("level"), part(3).cast("int").alias("x"), part(4).cast("int").alias("y"), "path", "length")


def read_tiles(tiles: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("id", "level", "x", "y")) -> tuple[DataFrame, DataFrame]:
    """(tiles found, misses once each) for requests."""
    found = requests.join(tiles, list(keys))
    misses = requests.select(*keys).distinct().join(tiles, list(keys), "left_anti")
    return found, misses.withColumn("message_id", F.concat_ws(".", *keys))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Write tiles (id, level, x, y, data) whose write is accepted as files (S9); see ``placement.write_status``.

    Tiles that are there already are skipped, so a batch that ``foreachBatch`` repeats writes nothing twice.
    """
    tile_sink.register(tiles.sparkSession)
    tiles.where("status = 'ok'").select("id", "level", "x", "y", "data").write.format("tile_files").mode("append").option("path", path).save()


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Downloaded files (name, content) with ``good``: size and MD5 are those expected (name, size, md5)."""
    joined = files.join(expected, "name")
    return joined.withColumn("good", (F.octet_length("content") == F.col("size")) & (F.md5("content") == F.col("md5"))).drop("md5", "size")


def sampled_search(files: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a shuffle that the seed fixes (S14): the smallest hashes, so the order is the same on any cluster."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))), id_column).limit(n)


def judged(slides: DataFrame, least_width: int, least_height: int, least_bytes: int = 600 << 20) -> DataFrame:
    """Adds ``accepted`` and ``reason`` (P14): large enough, or, where the size is unknown, a large enough file."""
    unknown = F.col("width").isNull() | F.col("height").isNull()
    small = (F.col("width") < least_width) | (F.col("height") < least_height)
    reason = F.when(unknown & (F.col("file_size") < least_bytes), "unknown size, small file").when(~unknown & small, "too small")
    return slides.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def write_results(candidates: DataFrame, path: str) -> None:
    """Three JSON outputs: candidates, accepted, rejected."""
    candidates.write.mode("overwrite").json(f"{path}/candidates")
    candidates.where("accepted").write.mode("overwrite").json(f"{path}/accepted")
    candidates.where("not accepted").write.mode("overwrite").json(f"{path}/rejected")


def consume(stream: DataFrame, handle, checkpoint: str, available_now: bool = False):
    """A durable consumer (S11, S12, S13): ``handle(batch, id)`` runs once or, after a failure, again; progress is kept
    in the checkpoint, so events are acknowledged only when handled."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Counters beside a query, at no extra pass (S18); read them from the listener or an Observation of that name."""
    return df.observe(name, *[m.alias(n) for n, m in metrics.items()])


def probe(content: Column) -> Column:
    """Width, height and description from the first directory of a TIFF or BigTIFF's bytes, null if there is none.

    A prefix is enough if the directory lies in it.
    """
    @pandas_udf("struct<width:long,height:long,description:string>")
    def read(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_directory(b) if b is not None else (None, None, None) for b in raw], columns=["width", "height", "description"]).astype({"width": "Int64", "height": "Int64"})

    return read(content)


def first_directory(b: bytes) -> tuple[int | None, int | None, str | None]:
    """Tags 256, 257 and 270 of a TIFF's first directory."""
    none = (None, None, None)
    order = {b"II": "little", b"MM": "big"}.get(bytes(b[:2]))
    if order is None or len(b) < 8:
        return none
    number = lambda at, n: int.from_bytes(b[at : at + n], order)
    magic = number(2, 2)
    if magic not in (42, 43):
        return none
    # Sizes of an offset, of the number of entries, and of an entry.
    wide, head, entry = (8, 8, 20) if magic == 43 else (4, 2, 12)
    at = number(8 if magic == 43 else 4, wide)
    if at + head > len(b):
        return none
    found: dict[int, int | str] = {}
    for k in range(min(number(at, head), (len(b) - at - head) // entry)):
        p = at + head + k * entry
        tag, kind, count = number(p, 2), number(p + 2, 2), number(p + 4, wide)
        value = p + 4 + wide
        if tag in (256, 257):
            found[tag] = number(value, {1: 1, 3: 2, 4: 4, 16: 8}.get(kind, wide))
        elif tag == 270:
            start = value if count <= wide else number(value, wide)
            found[tag] = bytes(b[start : start + count]).rstrip(b"\0").decode("utf-8", "replace")
    return found.get(256), found.get(257), found.get(270)
