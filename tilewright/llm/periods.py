"""Periodic runs of words: multi-scale minimizers seed them, short periods are scanned directly.

A run is a maximal stretch of words with smallest period q that is ``TIMES`` periods and ``LEAST`` words long at least.
Periods up to ``SHORT`` are found by comparing every word with the one q places on. Longer ones fall into scales, each
half as long again as the one before. In a scale of periods up to k, blocks of k words are hashed, and of every window
of k / 3 blocks the least hash is a minimizer. Within a run all blocks of a period differ, and what is a minimizer in
one place is one a period further on; so two successive places of an equal minimizer are q apart. Each such pair is a
seed, which is extended to both sides by bisection over hashes of prefixes. Every run is then compared word for word,
and dropped if a part of its period will do.

Words are numbered by their bytes, so equal numbers are equal words. Hashes of blocks only propose: a clash can't make a
run, and to hide one it would have to fall between both places of every seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.flat import NOT_SPACE, flat, in_small_batches, mix, runs, spans

#: A run has so many periods at least, and so many words.
TIMES, LEAST = 3, 24
#: Periods up to this are scanned directly. The largest of a scale is GROWTH times that of the one before; windows of
#: k // WINDOW blocks of k words stand twice, a period apart, in every run of the scale as long as GROWTH <= 2 - 1 / WINDOW.
SHORT, GROWTH, WINDOW = 8, 1.5, 3

_MULTIPLIER = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))


class Prefixes:
    """Hashes of any stretch of a sequence of 64-bit values, from one running sum."""

    def __init__(self, x: np.ndarray):
        self.up, self.down = _powers(1 << max(16, len(x).bit_length()))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def blocks(self, k: int) -> np.ndarray:
        """Of every stretch of k values, in order."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every w values in a row."""
    n = len(x) - w + 1
    if w <= 32:
        size = 1
        while 2 * size <= w:
            x = best(x[: len(x) - size], x[size:])
            size *= 2
        return best(x[:n], x[w - size : w - size + n])
    padded = np.concatenate([x, np.full(-len(x) % w, x[-1])]).reshape(-1, w)
    before = best.accumulate(padded, axis=1).ravel()
    after = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[:n], before[w - 1 : w - 1 + n])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the least of some w in a row, ties all; those that hold no value never."""
    w = min(w, len(h))
    least = sliding(h, w, np.minimum)
    # A value is the least of a window if it reaches the greatest of the least values of its windows.
    edge = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero((h == most) & (h != _NONE))


def _stretches(x: np.ndarray, doc: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of one text with period q that are long enough."""
    if len(x) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(x) - q + 2, bool)
    same[1:-1] = (x[q:] == x[:-q]) & (doc[q:] == doc[:-q])
    turns = np.flatnonzero(same[1:] != same[:-1])
    start, end = turns[::2], turns[1::2] + q
    far = end - start >= max(LEAST, TIMES * q)
    return start[far], end[far]


def _extended(p: Prefixes, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many places further, ``most`` at most, the words from ``at`` on (or before it) equal those q places on."""
    low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        start = at - mid if back else at
        fits = p.of(start, mid) == p.of(start + q, mid)
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    return low


@lru_cache(1 << 16)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return tuple(out + [n] * (n > 1))


def _has_period(x: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether x[s:e] has period q; most that have not show it at once."""
    near = min(e, s + q + 64)
    return bool(np.array_equal(x[s : near - q], x[s + q : near]) and np.array_equal(x[s : e - q], x[s + q : e]))


def _smallest(x: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether no period under q will do for x[s:e], which has period q: by its length, such a one would divide q."""
    return not any(_has_period(x, s, e, q // f) for f in _prime_factors(q))


def find_runs(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of all runs, in this order. x: a number for each word; texts end at ``offsets``."""
    found: set[tuple[int, int, int]] = set()
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for q in range(1, SHORT + 1):
        for s, e in zip(*(v.tolist() for v in _stretches(x, doc, q)), strict=True):
            if _smallest(x, s, e, q):
                found.add((s, e, q))
    low = SHORT
    live, at, ends, p = np.zeros(0), None, None, None
    while True:
        long = sizes >= TIMES * (low + 1)
        if not long.any():
            break
        k = int(low * GROWTH)
        if at is None or long.sum() < len(live):  # texts too short for this scale go
            live = np.flatnonzero(long)
            at = np.flatnonzero(long[doc])
            kept = sizes[live]
            ends = np.repeat(np.cumsum(kept), kept)
            starts = ends - np.repeat(kept, kept)
            p = Prefixes(mix(x[at].astype(np.uint64) + np.uint64(1)))
        h = p.blocks(k)
        place = np.arange(len(h))
        h[place + k > ends[: len(h)]] = _NONE
        m = minimizers(h, k // WINDOW)
        m = m[np.argsort(h[m], kind="stable")]
        d = m[1:] - m[:-1]
        seed = np.flatnonzero((h[m[1:]] == h[m[:-1]]) & (d > low) & (d <= k) & (ends[m[1:]] == ends[m[:-1]]))
        a, q = m[seed], d[seed]
        if len(a):
            left = _extended(p, a, q, a - starts[a], True)
            right = _extended(p, a, q, ends[a] - q - a, False)
            s, e = a - left, a + right + q
            far = e - s >= np.maximum(LEAST, TIMES * q)
            for s, e, q in np.unique(np.stack([s[far], e[far], q[far]], 1), axis=0).tolist():
                s, e = int(at[s]), int(at[e - 1]) + 1
                if _has_period(x, s, e, q):
                    exact = [(s, e)]
                else:  # hashes clashed: look at every word of the text
                    of = slice(offsets[doc[s]], offsets[doc[s] + 1])
                    exact = [(int(a + of.start), int(b + of.start)) for a, b in zip(*_stretches(x[of], doc[of], q), strict=True)]
                found.update((a, b, q) for a, b in exact if _smallest(x, a, b, q))
        low = k
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    of = doc[out[:, 0]] if len(out) else np.zeros(0, np.int64)
    return of, out[:, 0] - offsets[of], out[:, 1] - out[:, 0], out[:, 2]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, offset of each text's first word, bytes of the words without white space, their offsets)."""
    inside = NOT_SPACE[data]
    starts, ends, doc = spans(inside, offsets)
    held = data[inside]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(held)])
    number = column.dictionary_encode().indices.to_numpy()
    return number, np.searchsorted(doc, np.arange(len(offsets))), held, at


def collapsed(keep: np.ndarray, held: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each text its words with ``keep``, joined by one space."""
    size = np.diff(at)
    kept = size[keep]
    out = np.full(int(kept.sum()) + len(kept), 0x20, np.uint8)
    out[np.arange(int(kept.sum())) + np.repeat(np.arange(len(kept)), kept)] = held[np.repeat(keep, size)]
    end = np.concatenate([[0], np.cumsum(kept + 1)])
    before = np.concatenate([[0], np.cumsum(keep)])
    raw = out.tobytes()
    return [raw[end[before[a]] : max(end[before[b]] - 1, end[before[a]])] for a, b in zip(first, first[1:], strict=False)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ..) to (runs, collapsed, ..)."""
    for batch in batches:
        data, offsets = flat(batch.column(0))
        lists, texts = [], []
        for i, j, part, off in runs(data, offsets):
            number, first, held, at = _words(part, off)
            of, start, length, period = find_runs(number, first)
            drop = np.zeros(len(number) + 1, np.int64)
            np.add.at(drop, first[of] + start + period, 1)
            np.add.at(drop, first[of] + start + length, -1)
            texts += collapsed(np.cumsum(drop)[:-1] == 0, held, at, first)
            cut = pa.array(np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32))
            lists.append(pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))))
        found = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(_RUN))
        yield pa.RecordBatch.from_arrays([found, pa.array(texts, pa.binary()).cast(pa.string()), *batch.columns[1:]], ["runs", "collapsed", *batch.schema.names[1:]])


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """For each row of ``docs``: row (a struct of the columns ``keep``, by default doc_id), runs and collapsed.

    Words stand between white space (0x20, 0x09-0x0D) and are compared as written; places count from 0. runs has
    start, length and period of every run, by start, then period. collapsed has the words, joined by one space, that no
    run holds beyond its first period. A null or blank text has no runs and an empty collapsed text; rows are judged by
    their text alone, so repeated rows have equal results; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row")
    chosen = in_small_batches(docs).select(F.col(f"`{text}`").alias("text"), row)
    kind = chosen.schema["row"].dataType.simpleString()
    return chosen.mapInArrow(_find, f"runs array<struct<start:long,length:long,period:long>>, collapsed string, row {kind}").select("row", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, periods planted in a tenth of the texts as the query's contract says.

    With h = crc32(doc_id in decimal) and h % 10 = 0, each word i >= a of n becomes original word a + (i - a) % p, where
    g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(chosen, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))).alias("w"))
    placed = words.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def best(found: Column) -> Column:
    """The run with the greatest length / period, ties to the first; null without runs. Quotients are compared exactly."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(found) > 0, F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("best", best(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
