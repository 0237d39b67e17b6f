"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features: tokens are stretches of letters and digits, and stretches of other visible bytes, as written. A token that
repeats the one before it counts as one shared repeat token, so that repetition is a word of its own. Single tokens and
pairs are hashed to ``BITS`` bits; a feature's value is its share of the text's tokens times ``SCALE``. A score is then
one sum of gathered weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.flat import NOT_SPACE, WORD_ANY_CASE, flat, in_small_batches, mix, runs, span_hashes
from tilewright.session import stage

BITS, SCALE = 20, 20.0
#: Labelled ids fitted on, about, drawn by a hash; all of them if there are fewer. Of each at most so many texts for a label.
SAMPLE, TEXTS = 12_000, 4
#: Of the updates: learning rate, its offset, penalties on size and square, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.05, 0.01, 3
#: Labels up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
REPEAT = np.uint64(0x5245504541540000)

_KIND = NOT_SPACE.astype(np.int8) + WORD_ANY_CASE


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text) of every single token and pair of a run, and tokens per text."""
    n = len(offsets) - 1
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    seen = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    h = span_hashes(data, starts, ends, lower=False)
    doc = np.searchsorted(offsets, starts, "right") - 1
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h = np.where(same, REPEAT, h)
    inner = doc[1:] == doc[:-1]
    pairs = mix(h[:-1] * np.uint64(3) ^ h[1:])[inner]
    shift = np.uint64(64 - BITS)
    return (np.concatenate([mix(h), pairs]) >> shift).astype(np.int64), np.concatenate([doc, doc[1:][inner]]), np.bincount(doc, minlength=n)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, features, values), features distinct."""
    for batch in batches:
        data, offsets = flat(batch.column(2))
        for i, j, part, off in runs(data, offsets):
            index, doc, n = features(part, off)
            both, count = np.unique(doc << BITS | index, return_counts=True)
            edges = np.searchsorted(both, np.arange(j - i + 1) << BITS)
            index = (both & ((1 << BITS) - 1)).astype(np.int32)
            values = (SCALE * count / n[both >> BITS]).astype(np.float32)
            cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            blobs = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (index, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *blobs], ["id", "label", "features", "values"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not 0; the last index, ``2**BITS``, is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(k):
        w = -(z[k] - np.sign(z[k]) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)
        return np.where(np.abs(z[k]) > L1, w, 0.0)

    bias = np.array([1 << BITS])
    for _ in range(passes):
        for label, k, x in rows:
            k, x = np.concatenate([k, bias]), np.append(x, 1.0)
            w = weights(k)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    full = np.flatnonzero(np.abs(z) > L1)
    return full, weights(full)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for i, label, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((i, label, np.frombuffer(k, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float)))
    if rows:
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1], r[2].tobytes()))
        k, w = ftrl([r[1:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([k.astype(np.int32).tobytes()], pa.binary()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["features", "weights"])


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """Distinct (id, label) to learn from: labels 0 and 1 of ids outside fold ``held``. Null ids or labels are left out."""
    return labels.where(F.col(column).isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label")).distinct()


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """Weights by feature, the bias last, from texts of at most about ``sample`` labelled ids of ``docs`` (doc_id, text).

    Conflicting labels of an id all count; rows of ``docs`` with one id count once for each text, for ``TEXTS`` of them
    at most, drawn by a hash. Null ids are not learnt from. All weights are 0 without labelled rows. The sample's
    features go through one task; it is bounded.
    """
    mine = stage(labelled(labels, column, folds, held), "quality-labels")
    share = sample / max(mine.count(), 1)
    if share < 1:
        mine = mine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most the sample's ids: small enough to broadcast.
    text = in_small_batches(docs).select(F.col("doc_id").alias("d"), "text").join(F.broadcast(mine), F.col("d") == F.col("id")).select("id", "label", "text")
    rows = text.mapInArrow(_feature_rows, "id long, label int, features binary, values binary").distinct()
    nth = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("features", "values"), "features", "values"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= TEXTS).drop("nth")
    got = rows.coalesce(1).mapInArrow(_fit, "features binary, weights binary").first()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if got:
        weights[np.frombuffer(got[0], np.int32)] = np.frombuffer(got[1], np.float32)
    return weights


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1 of whole texts; null or empty ones get that of the bias."""
    data, offsets = flat(texts)
    out = np.zeros(len(texts))
    for i, j, part, off in runs(data, offsets):
        index, doc, n = features(part, off)
        out[i:j] = np.bincount(doc, weights[index], j - i) * (SCALE / np.maximum(n, 1))
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), shared.value))], ["doc_id", "score"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def kept(docs: DataFrame, score_texts, keep) -> DataFrame:
    """Rows of ``docs``, all columns, whose text's score ``keep`` accepts. ``score_texts`` is sent to the executors."""
    shared, at = docs.sparkSession.sparkContext.broadcast(score_texts), docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(shared.value(batch.column(at))), pa.bool_()))

    return in_small_batches(docs).mapInArrow(choose, docs.schema)


class Scorer:
    """Scores of texts by given weights, as an object that can be broadcast."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return scores(texts, self.weights)


#: Of the registered query: labels with ``crc32 % FOLDS == HELD`` are held out; good from THRESHOLD on.
FOLDS, HELD, THRESHOLD = 5, 0, 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", FOLDS, HELD)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of low quality go.

    Rows are judged by their text alone: repeated rows share a fate, null and empty texts have the score of the bias.
    An empty table stays empty; all columns stay as they are.
    """
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", FOLDS, HELD)
    return kept(docs, Scorer(weights), lambda s: s >= THRESHOLD)
