"""Texts of an Arrow batch as one run of UTF-8 bytes, with words and hashes found by numpy over all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that are worked on at once; one longer text makes a longer run.
RUN_BYTES = 1 << 20
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send texts to Python ``BATCH_ROWS`` rows at a time, unless it asks for fewer.

    A batch stands in the JVM's direct memory and in the worker's at once.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING)) > BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split into (first text, end text, bytes, offsets) of about ``most`` bytes, whole texts each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal stretches of True bytes; none crosses from text to text."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (_MULTIPLIER, _INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def byte_values(lower: bool) -> np.ndarray:
    """A fixed 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    if lower:
        v[65:91] = v[97:123]
    return v


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span's bytes, from one running sum of byte value times position power."""
    n = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(n)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(lower)[data] * up[: len(data)], out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def table_of(chars: bytes, value: bool = False) -> np.ndarray:
    """Lookup by byte: ``value`` for the bytes given, else its opposite."""
    t = np.full(256, not value)
    t[list(chars)] = value
    return t


#: Fixed classes: bytes of words between white space (0x20, 0x09-0x0D), and bytes of words of letters and digits.
NOT_SPACE = table_of(bytes([0x20, *range(0x09, 0x0E)]))
WORD = table_of(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: The same after A-Z are lower-cased.
WORD_ANY_CASE = WORD | table_of(bytes(range(0x41, 0x5B)), True)
