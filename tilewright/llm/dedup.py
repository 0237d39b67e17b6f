"""Exact dedup by composable polynomial fingerprints, confirmed chunk by chunk.

A text's fingerprint is the sum of byte i times BASE ** i modulo two primes, so the fingerprint of a whole is the sum of
its chunks' fingerprints, each shifted by its start: chunks of a huge text are hashed in tasks of their own and added up
by Spark. Texts of one fingerprint and length are then compared chunk by chunk, without being gathered: they are equal
if, of every chunk, the least and the greatest bytes are the same. Spark keeps one pair of chunks for each task, so a
text with any number of copies is sent once by each task. Texts that share a fingerprint but differ are told apart by
their SHA-256, and compared again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.flat import in_small_batches, runs
from tilewright.session import stage

#: Fixed values of the fingerprint: two primes under 2 ** 31, and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_893)
#: Bytes of a chunk (under 2 ** 24, so that sums stay whole); a text of more is hashed in parts.
CHUNK = 1 << 20
#: Repeated texts up to this many are broadcast; more are joined by a shuffle. A class with one of HOT of all rows is hot.
BROADCAST_ROWS, HOT = 200_000, 1_000


def normalised(text: Column) -> Column:
    """UTF-8 bytes of the text, each stretch of white space (0x20, 0x09-0x0D) as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary")


def chunk_count(data: Column, size: int) -> Column:
    """Chunks of ``size`` that the bytes have; one, empty, for no bytes."""
    return F.greatest(F.ceil(F.octet_length(data) / F.lit(size)), F.lit(1)).cast("int")


def chunks(data: Column, size: int) -> Column:
    """The bytes in chunks of ``size``, in order."""
    n = chunk_count(data, size)
    return F.when(n == 1, F.array(data)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size))))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(4)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** i modulo prime for i < n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


def chunk_prints(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, primes: Sequence[int] = PRIMES) -> list[np.ndarray]:
    """For each chunk of a run and each prime: its fingerprint, shifted by its start in its text."""
    out = []
    for base, prime in zip(BASES, primes, strict=True):
        p = np.uint64(prime)
        n = 1 << max(20, int(len(data)).bit_length())
        up, down = _powers(base % prime, prime, n), _powers(pow(base, -1, prime), prime, n)
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], out=c[1:])
        h = (c[offsets[1:]] - c[offsets[:-1]]) % p * down[offsets[:-1]] % p
        shift = np.array([pow(base, int(s), prime) for s in starts], np.uint64) if starts.any() else np.uint64(1)
        out.append((h * shift % p).astype(np.int64))
    return out


def _hash(primes: Sequence[int], size: int):
    """(h1, h2, bytes, wait, no, data, ..) to the same with hashes of the data; where ``wait`` holds, the data goes on unhashed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wait, no, data = batch.column(3), batch.column(4).to_numpy().astype(np.int64), batch.column(5)
            now, offsets = _bytes(pc.if_else(wait, None, data))
            h = np.zeros((2, batch.num_rows), np.int64)
            for i, j, part, off in runs(now, offsets):
                h[:, i:j] = chunk_prints(part, off, no[i:j] * size, primes)
            mask = wait.to_numpy(zero_copy_only=False)
            hashed = [pa.array(v, mask=mask) for v in (h[0], h[1], np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([*hashed, wait, batch.column(4), pc.if_else(wait, data, None), *batch.columns[6:]], batch.schema.names)

    return go


def fingerprints(docs: DataFrame, keep: Sequence[str], text: str = "text", primes: Sequence[int] = PRIMES, size: int = CHUNK) -> DataFrame:
    """A row for each row of ``docs``, staged: uid, row (a struct of the columns ``keep``), sha, print and bytes.

    Texts of one chunk are hashed where they are read. Chunks of larger ones are written, dealt out to other tasks, and
    their shifted hashes added up.
    """
    empty = lambda kind: F.lit(None).cast(kind)
    named = in_small_batches(docs).select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), normalised(F.col(f"`{text}`")).alias("data"))
    cut = named.select("uid", "row", F.sha2("data", 256).alias("sha"), (chunk_count(F.col("data"), size) > 1).alias("wait"), F.posexplode(chunks(F.col("data"), size)).alias("no", "data"))
    first = F.col("no") == 0
    cut = cut.select(empty("long").alias("h1"), empty("long").alias("h2"), empty("long").alias("bytes"), "wait", "no", "data", "uid", F.when(first, F.col("row")).alias("row"), F.when(first, F.col("sha")).alias("sha"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    pieces = stage(cut.mapInArrow(_hash(primes, size), schema), "dedup-pieces")
    print_of = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b).alias("print")
    short = pieces.where("not wait").select("uid", "row", "sha", print_of(F.col("h1"), F.col("h2")), "bytes")
    parts = pieces.where("wait").drop("row", "sha").withColumn("wait", F.lit(False)).repartition("uid", "no").mapInArrow(_hash(primes, size), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("row", "sha").schema))
    whole = parts.groupBy("uid").agg(*[F.pmod(F.sum(h), F.lit(p)).alias(h) for h, p in zip(("h1", "h2"), primes, strict=True)], F.sum("bytes").alias("bytes"))
    long = whole.join(pieces.where("wait and no = 0").select("uid", "row", "sha"), "uid").select("uid", "row", "sha", print_of(F.col("h1"), F.col("h2")), "bytes")
    return stage(short.union(long), "dedup-prints")


def _classes(prints: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Of each value of ``keys`` that two rows or more have: their number, keep_id, and the uid of the row that stays."""
    first = F.min(F.struct(F.col(f"row.`{id_column}`").isNull().alias("unnamed"), F.col(f"row.`{id_column}`").alias("id"), "uid")).alias("first")
    return prints.groupBy(*keys).agg(F.count("*").alias("copies"), first).where("copies > 1").select(*keys, "copies", F.col("first.id").alias("keep"), F.col("first.uid").alias("stays"))


def _different(docs: DataFrame, text: str, shas: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Values of ``keys`` whose texts differ in some chunk. ``shas``: sha and keys of every text to compare."""
    few = shas.count() <= BROADCAST_ROWS
    data = docs.select(normalised(F.col(f"`{text}`")).alias("data")).select("data", F.sha2("data", 256).alias("sha"))
    of = data.join(F.broadcast(shas) if few else shas, "sha").select(*keys, F.posexplode(chunks(F.col("data"), size)).alias("no", "data"))
    return of.groupBy(*keys, "no").agg(F.min("data").alias("least"), F.max("data").alias("greatest")).where("least <> greatest").select(*keys).distinct()


def exact_dedup(docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_column: str = "doc_id", text: str = "text", primes: Sequence[int] = PRIMES, size: int = CHUNK) -> DataFrame:
    """A row for each row of ``docs``: row (a struct of the columns ``keep``, the id among them), keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each stretch of white space is made one space; a null text is an empty one. Of
    equal texts that with the smallest id stays, null ids last; of rows that repeat an id and a text one stays. keep_id
    is null only if all ids of a group are. text_sha256 is of the normalised text. Other columns are not read; an empty
    table gives an empty result.
    """
    prints = fingerprints(docs, keep, text, primes, size)
    keys = ["print", "bytes"]
    classes = stage(_classes(prints, keys, id_column), "dedup-classes")

    def clash(found: DataFrame, by: list[str]) -> DataFrame:
        shas = prints.join(found.select(*keys), keys, "left_semi").select("sha", *keys).distinct()
        return stage(_different(docs, text, stage(shas, "dedup-compared"), by, size), "dedup-different")

    mixed = clash(classes, keys)
    if mixed.count():
        # Fingerprints that differing texts share: their classes are told apart by SHA-256.
        if clash(mixed, [*keys, "sha"]).count():
            raise ValueError("texts that differ have one SHA-256")
        apart = prints.join(mixed, keys, "left_semi")
        prints = prints.join(mixed, keys, "left_anti").withColumn("part", F.lit("")).union(apart.withColumn("part", F.col("sha")))
        keys = [*keys, "part"]
        prints = stage(prints, "dedup-apart")
        classes = stage(_classes(prints, keys, id_column), "dedup-classes")
    # Rows of a hot class stay where they are: there are HOT such classes at most.
    hot = classes.where(F.col("copies") * HOT >= prints.count())
    joined = lambda rows, of: rows.join(of, keys, "left")
    both = joined(prints.join(F.broadcast(hot.select(*keys)), keys, "left_semi"), F.broadcast(hot)).union(joined(prints.join(F.broadcast(hot.select(*keys)), keys, "left_anti"), classes))
    alone = F.col("copies").isNull()
    return both.select(
        "row",
        F.when(alone, F.col(f"row.`{id_column}`")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("stays"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents
)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from t
"""
