"""Toxicity: class-conditional Kneser-Ney models of words, compared on short expressions.

The class is the history: P(word | class) = (1 - B) * max(k - D, 0) / sum of these + B * P(word), where k is the number
of distinct left neighbours that the word has in the class (so copies of a text count once) and D the discount. The
backoff is shared: P(word) counts in how many classes a word occurs, and its weight B, the share of the neighbours that
discounting frees, is the larger of the two classes' own. So rare words get nearly the same probability in both, and
words never counted the same. An expression is one word or two words in a row. Its log-likelihoods in the two classes are
compared and divided by its own length plus ``PRIOR``, as if so many neutral words stood beside it; a text has the value
of its most toxic expression. A logistic curve turns values into scores; it is fitted on documents that the model it
uses has not counted.

Every counted word has its own ratio, in a table. Words that hold a ``WORDS``-th of all neighbours or more are broadcast,
so there are no more than that. Of the others, a table of fixed size holds bounds of the ratios for each range of word
hashes. That decides nearly all expressions; those that could still be a text's most toxic one are joined to the
words' own ratios.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.flat import WORD_ANY_CASE, flat, in_small_batches, mix, runs, span_hashes, spans
from tilewright.llm.quality import BROADCAST_ROWS, TEXTS, fold, labelled
from tilewright.session import stage

#: Neutral words that stand beside an expression of one or two words.
PRIOR = 30
#: Words with at least this share (one of so many) of all neighbours are broadcast with their ratios.
WORDS = 1 << 18
#: Ranges of word hashes that bounds of ratios are broadcast for: 2 ** BITS, two bytes each, made in parts of 2 ** PART.
BITS, PART = 23, 15
#: Labelled ids that the curve is fitted on, about.
SAMPLE = 10_000
#: Word-neighbour pairs of a chunk, and of a hash range, about.
CHUNK = RANGE = 1 << 21


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (64 bits, A-Z lower-cased) and its text."""
    starts, ends, doc = spans(WORD_ANY_CASE[data], offsets)
    return span_hashes(data, starts, ends), doc


def distinct(word: np.ndarray, before: np.ndarray, kind: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct pairs (word, before) with all bits of their kinds, sorted by part, if given, then word."""
    order = np.lexsort((before, word) if part is None else (before, word, part))
    word, before, kind = word[order], before[order], kind[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (before[1:] != before[:-1]))) if len(word) else np.zeros(0, np.int64)
    out = word[first], before[first], np.bitwise_or.reduceat(kind, first) if len(first) else kind
    return out if part is None else (*out, part[order][first])


def _send(bits: int):
    """(kind, text) to distinct (word, neighbour) pairs with the kinds they occur in, a row for each range of the pairs' hashes.

    A range holds some neighbours of many words, so no range has all pairs of a frequent word.

    kind: 1 ordinary, 2 toxic, shifted by 2 for documents of the second half.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal size
            word, before, kind = (np.concatenate(x) for x in zip(*pairs, strict=True))
            part = mix(word * np.uint64(3) ^ mix(before)) >> np.uint64(64 - bits) if bits else np.zeros(len(word), np.uint64)
            word, before, kind, part = distinct(word, before, kind, part.astype(np.uint16 if bits <= 16 else np.uint64))
            keep, edges = np.unique(part, return_index=True)
            edges = [*edges.tolist(), len(part)]
            pairs.clear()
            size = 0
            cut = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), cut(word), cut(before), cut(kind)], ["part", "words", "before", "kinds"])

        for batch in batches:
            kind = batch.column(0).to_numpy().astype(np.uint8)
            data, offsets = flat(batch.column(1))
            for i, _, part, off in runs(data, offsets):
                h, doc = words(part, off)
                if not len(h):
                    continue
                before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
                before[1:][doc[1:] != doc[:-1]] = 0
                pairs.append((h, before, kind[i + doc]))
                size += len(h)
                if size >= CHUNK:
                    yield emit()
        if size:
            yield emit()

    return send


_COUNTS = "word long, ordinary long, toxic long, half_ordinary long, half_toxic long"


def _count(rows: pa.Table) -> pa.Table:
    """Of one range of pairs: each word's distinct neighbours by class, in all documents and in the first half."""
    read = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in rows.column(name).to_pylist()])
    word, _, kind = distinct(read("words", np.uint64), read("before", np.uint64), read("kinds", np.uint8))
    word, at = np.unique(word, return_inverse=True)
    count = lambda mask: pa.array(np.bincount(at, (kind & mask) > 0, len(word)).astype(np.int64))
    return pa.Table.from_arrays([pa.array(word.view(np.int64)), count(5), count(10), count(1), count(2)], ["word", "ordinary", "toxic", "half_ordinary", "half_toxic"])


class Model:
    """Log-likelihood ratios of the broadcast words, bounds of the others', and the curve from a value to a score.

    A word never counted has 0. ``levels`` has two rows, each with a level for each range of word
    hashes: 0 if no counted word is in it, else all ratios in it are more than base + step * (the first - 1), and at
    most base + step * the second.
    """

    def __init__(self, word: np.ndarray, ratio: np.ndarray, levels: np.ndarray | None = None, base: float = 0.0, step: float = 0.0):
        self.word, self.ratio, self.levels, self.base, self.step = word, ratio, levels, base, step
        self.slope = self.centre = 0.0

    def bounds(self, texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Least possible value of each text, and what is open: (text, word, second word or 0, known, upper bound).

        An open expression is a word alone or with ``known``, the largest known ratio beside it (-inf without any), or
        two words. A text's value is the least possible one or that of an open expression; -inf without words.
        """
        data, offsets = flat(texts)
        least = np.full(len(texts), -np.inf)
        found = []
        for i, j, part, off in runs(data, offsets):
            h, doc = words(part, off)
            if not len(h):
                continue
            at = np.searchsorted(self.word, h).clip(0, max(len(self.word) - 1, 0))
            mine = self.word[at] == h if len(self.word) else np.zeros(len(h), bool)
            r = np.where(mine, self.ratio[at] if len(self.word) else 0.0, 0.0)
            new, low, high = np.zeros(len(h), bool), r, r
            if self.levels is not None:
                first, last = self.levels[:, (h >> np.uint64(64 - BITS)).astype(np.int64)].astype(float)
                new = ~mine & (last > 0)
                # A word of the range may be one that was never counted.
                low = np.where(new, np.minimum(self.base + self.step * (first - 1), 0.0), r)
                high = np.where(new, np.maximum(self.base + self.step * last, 0.0), r)
            inner = doc[1:] == doc[:-1]
            n = np.bincount(doc, minlength=j - i)
            full = n > 0
            value = low / (1 + PRIOR)
            value[1:] = np.maximum(value[1:], np.where(inner, (low[1:] + low[:-1]) / (2 + PRIOR), -np.inf))
            least[i:j][full] = np.maximum.reduceat(value, (np.cumsum(n) - n)[full])
            known = np.full(len(h), -np.inf)
            known[1:] = np.where(inner & ~new[:-1], r[:-1], -np.inf)
            known[:-1] = np.maximum(known[:-1], np.where(inner & ~new[1:], r[1:], -np.inf))
            one = np.flatnonzero(new)
            two = np.flatnonzero(inner & new[1:] & new[:-1])
            a = np.concatenate([h[one], h[two]])
            b = np.concatenate([np.zeros(len(one), np.uint64), h[two + 1]])
            d = np.concatenate([doc[one], doc[two]])
            k = np.concatenate([known[one], np.full(len(two), -np.inf)])
            upper = np.concatenate([np.maximum(high[one] / (1 + PRIOR), (high[one] + known[one]) / (2 + PRIOR)), (high[two] + high[two + 1]) / (2 + PRIOR)])
            may = upper > least[i:j][d]
            a, b, d, k, upper = a[may], b[may], d[may] + i, k[may], upper[may]
            order = np.lexsort((k, b, a, d))
            a, b, d, k, upper = a[order], b[order], d[order], k[order], upper[order]
            last = np.append((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1]), True)[: len(a)]
            found.append((d[last], a[last], b[last], k[last], upper[last]))
        kinds = (np.int64, np.uint64, np.uint64, np.float64, np.float64)
        return least, tuple(np.concatenate([np.zeros(0, t), *(f[c] for f in found)]) for c, t in enumerate(kinds))

    def score(self, values: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; 0 for texts without words, and for all if there were no labels of both classes."""
        if not self.slope:
            return np.zeros(len(values))
        return 1 / (1 + np.exp(-np.clip(self.slope * (values - self.centre), -700, 35)))


class Trained(NamedTuple):
    """A model, and the ratios (word, ratio) of the counted words that it doesn't hold; None if it holds all."""

    model: Model
    rest: DataFrame | None


def ratios(counts: np.ndarray, totals: np.ndarray, vocabulary: np.ndarray, seen: float, discount: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) for rows of counts (ordinary, toxic); 0 for a word never counted.

    totals, vocabulary and discount: sum of counts, number of words and D of either class; seen: the sum of the classes
    that words occur in.
    """
    shared = ((counts > 0).sum(1) + 0.5) / (seen + 0.5 * (vocabulary.max() + 1))
    freed = discount * vocabulary
    backoff = (freed / totals).max()
    own = np.maximum(counts - discount, 0) / np.maximum(totals - freed, 1e-9)
    logs = np.log((1 - backoff) * own + backoff * shared[:, None])
    return logs[:, 1] - logs[:, 0]


def levels_of(own: DataFrame, base: float, step: float) -> np.ndarray:
    """For each range of word hashes the least and the largest level of its ratios, 0 for none: two rows of bytes.

    The level is the least that base + step * level reaches the ratio with, 255 at most. Spark puts levels together in
    parts of fixed length; 2 ** (BITS + 1) bytes come to the driver.
    """
    level = F.least(F.greatest(F.ceil((F.col("ratio") - base) / step), F.lit(1)), F.lit(255)).cast("int")
    of = own.select(F.shiftrightunsigned("word", 64 - BITS).cast("int").alias("at"), level.alias("level")).groupBy("at").agg(F.min("level").alias("first"), F.max("level").alias("last"))

    def part(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        out = np.zeros((2, 1 << PART), np.uint8)
        out[0, at & ((1 << PART) - 1)], out[1, at & ((1 << PART) - 1)] = rows.column("first").to_numpy(), rows.column("last").to_numpy()
        return pa.table({"part": pa.array([int(at[0]) >> PART], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((2, 1 << BITS), np.uint8)
    for k, levels in of.groupBy(F.shiftright("at", PART).alias("k")).applyInArrow(part, "part int, levels binary").toLocalIterator():
        out[:, k << PART : (k + 1) << PART] = np.frombuffer(levels, np.uint8).reshape(2, -1)
    return out


def curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and centre of a logistic curve, by Newton's steps with a small penalty on the slope; classes weigh the same."""
    # In the scale of one word's ratio, so that the penalty does not depend on PRIOR.
    x = np.clip(np.where(np.isfinite(values), values * (1 + PRIOR), -10), -10, 20)
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * 1000
    a, b = 1.0, -x.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(weight * (p - labels) * x).sum() + a, (weight * (p - labels)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-6)
    return float(a * (1 + PRIOR)), float(-b / a / (1 + PRIOR))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 3, held: int = 1) -> Trained:
    """The model from all labelled rows of ``docs`` (doc_id, text) outside fold ``held``.

    Word counts cover all of them. Of conflicting labels of an id all count. The curve is fitted with counts of the
    first half, on the values of about ``SAMPLE`` ids of the second, ``TEXTS`` for each id and label at most.
    """
    spark = docs.sparkSession
    mine = stage(labelled(labels, column, folds, held), "toxicity-labels")
    n = mine.count()
    second = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    joined = in_small_batches(docs).select(F.col("doc_id").alias("d"), "text").join(F.broadcast(mine) if n <= BROADCAST_ROWS else mine, F.col("d") == F.col("id"))
    per_range = max(2 * spark.sparkContext.defaultParallelism, docs.count() * 500 // RANGE)
    sent = joined.select(F.expr("shiftleft(1, label + if(pmod(xxhash64(id), 2) = 1, 2, 0))").alias("kind"), "text").mapInArrow(_send((per_range - 1).bit_length()), "part int, words binary, before binary, kinds binary")
    columns = ["ordinary", "toxic", "half_ordinary", "half_toxic"]
    # A pair is in one range only, so a word's counts add up.
    counts = stage(sent.groupBy("part").applyInArrow(_count, _COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]), "toxicity-words")
    sums = counts.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("k", F.sum), ("v", lambda c: F.count_if(F.col(c) > 0)), ("one", lambda c: F.count_if(F.col(c) == 1)), ("two", lambda c: F.count_if(F.col(c) == 2)))]).first()
    number = lambda k, half="": np.array([float(sums[f"{k}_{half}{c}"] or 0) for c in ("ordinary", "toxic")])
    # Toxic neighbours weigh more: the fewer words of high ratio are joined, the fewer expressions are open.
    weight = F.col("ordinary") + 4 * F.col("toxic")
    total = int((sums["k_ordinary"] or 0) + 4 * (sums["k_toxic"] or 0))
    frequent = weight * WORDS >= total  # WORDS words at most
    rows = counts.where(frequent).toPandas()
    rows = rows.iloc[np.argsort(rows["word"].to_numpy().astype(np.int64).view(np.uint64))]
    word = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    if not (number("k", "half_").all() and number("k").all()):
        return Trained(Model(np.zeros(0, np.uint64), np.zeros(0)), None)

    def parameters(half: str) -> tuple:
        k, v, one, two = (number(x, half) for x in ("k", "v", "one", "two"))
        return k, v, v.sum(), np.where(one > 0, one / np.maximum(one + 2 * two, 1), 0.5)

    halves = {half: parameters(half) for half in ("", "half_")}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratios(c[:, :2], *halves[""])), pa.array(ratios(c[:, 2:], *halves["half_"]))], ["word", "ratio", "half_ratio"])

    rest = stage(counts.where(~frequent).select("word", *columns).mapInArrow(rate, "word long, ratio double, half_ratio double"), "toxicity-rest")
    ends = rest.agg(*[f(c).alias(f"{k}_{c}") for c in ("ratio", "half_ratio") for k, f in (("low", F.min), ("high", F.max))]).first()

    def fitted(half: str) -> Trained:
        ratio = ratios(rows[[f"{half}ordinary", f"{half}toxic"]].to_numpy().astype(float), *halves[half])
        low, high = ends[f"low_{half}ratio"], ends[f"high_{half}ratio"]
        if low is None:
            return Trained(Model(word, ratio), None)
        own = rest.select("word", F.col(f"{half}ratio").alias("ratio"))
        base, step = low - 1e-9, max((high - low) / 254, 1e-9)
        return Trained(Model(word, ratio, levels_of(own, base, step), base, step), own)

    share = min(1.0, SAMPLE / max(n / 2, 1))
    drawn = mine.where(second & (F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(1 << 30)) < int(share * (1 << 30))))
    chosen = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(drawn), F.col("d") == F.col("id")).select("id", "label", "text")
    # Spark keeps TEXTS rows of an id and label in each task before it sorts them, so an id of many rows is no hot key.
    nth = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("value"), "value"))
    values = valued(chosen, fitted("half_")).distinct().withColumn("nth", nth).where(F.col("nth") <= TEXTS).select("label", "value").toPandas()
    trained = fitted("")
    if values["label"].nunique() == 2:
        trained.model.slope, trained.model.centre = curve(values["value"].to_numpy(), values["label"].to_numpy())
    return trained


#: Two hashes of a text, that open expressions are put together by: equal texts have equal values.
_KEYS = {"k1": F.xxhash64, "k2": lambda text: F.xxhash64(F.lit("text"), text)}
_OPEN = "array<struct<word:long,second:long,known:double>>"
_ARROW_OPEN = pa.list_(pa.struct([("word", pa.int64()), ("second", pa.int64()), ("known", pa.float64())]))


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    return in_small_batches(docs).select(*columns, *[f(F.col("text")).alias(k) for k, f in _KEYS.items()], "text")


def _lists(rest: tuple[np.ndarray, ...], n: int) -> pa.Array:
    """What is open as a list for each of ``n`` texts."""
    text, word, second, known, _ = rest
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(second.view(np.int64), mask=second == 0), pa.array(known)], ["word", "second", "known"])
    return pa.ListArray.from_arrays(pa.array(offsets), structs).cast(_ARROW_OPEN)


def _closed(opened: DataFrame, trained: Trained) -> DataFrame:
    """k1, k2 and best: the largest value of the expressions in column ``open``, each text's once."""
    ratio = lambda name: trained.rest.select(F.col("word").alias(f"{name}_word"), F.col("ratio").alias(name))
    texts = opened.groupBy("k1", "k2").agg(F.first("open").alias("open"))
    parts = texts.select("k1", "k2", F.inline("open"))
    one = parts.join(ratio("a"), F.col("word") == F.col("a_word"), "left")
    # Expressions without a second word are dealt by their text, as nulls would meet in one task.
    both = one.join(ratio("b"), (F.coalesce("second", "k1") == F.col("b_word")) & F.col("second").isNotNull(), "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    value = F.when(F.col("second").isNotNull(), (a + b) / (2 + PRIOR)).otherwise(F.greatest(a / (1 + PRIOR), (F.col("known") + a) / (2 + PRIOR)))
    return both.groupBy("k1", "k2").agg(F.max(value).alias("best"))


def valued(docs: DataFrame, trained: Trained) -> DataFrame:
    """Columns of ``docs`` but its text, and the text's value."""
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)
    columns = [c for c in docs.columns if c != "text"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, rest = shared.value.bounds(batch.column(len(columns) + 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(least), _lists(rest, len(least))], [*columns, *_KEYS, "value", "open"])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    first = _keyed(docs, columns).mapInArrow(bound, f"{types}k1 long, k2 long, value double, open {_OPEN}")
    if trained.rest is None:
        return first.select(*columns, "value")
    first = stage(first, "toxicity-bounds")
    opened = first.where(F.size("open") > 0)
    whole = opened.select(*columns, *_KEYS, "value").join(_closed(opened, trained), list(_KEYS)).select(*columns, F.greatest("value", "best").alias("value"))
    return first.where(F.size("open") == 0).select(*columns, "value").union(whole)


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id and score for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_numpy(zero_copy_only=False)))], ["doc_id", "score"])

    return valued(docs.select("doc_id", "text"), trained).mapInArrow(score, "doc_id long, score double")


def without(docs: DataFrame, trained: Trained, threshold: float) -> DataFrame:
    """Rows of ``docs``, all columns, with scores under ``threshold``."""
    spark = docs.sparkSession
    shared, at = spark.sparkContext.broadcast(trained.model), docs.columns.index("text")

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            least, rest = model.bounds(batch.column(2))
            text, upper = rest[0], rest[4]
            may = (model.score(least)[text] < threshold) & (model.score(upper) >= threshold)
            lists = _lists(tuple(x[may] for x in rest), len(least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], [*_KEYS, "open"]).filter(pa.array(np.bincount(text[may], minlength=len(least)) > 0))

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], [*_KEYS])
            yield got.filter(pa.array(shared.value.score(batch.column(2).to_numpy(zero_copy_only=False)) >= threshold))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(shared.value.bounds(batch.column(at))[0]) < threshold))

    if trained.rest is None:
        return in_small_batches(docs).mapInArrow(low, docs.schema)
    opened = _keyed(docs, []).mapInArrow(undecided, f"k1 long, k2 long, open {_OPEN}")
    gone = stage(_closed(opened, trained).select("k1", "k2", "best").mapInArrow(toxic, "k1 long, k2 long"), "toxicity-gone")
    rest = in_small_batches(docs).mapInArrow(low, docs.schema)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    match = [f(rest["text"]) == gone[k] for k, f in _KEYS.items()]
    return rest.join(gone, match, "left_anti")


#: Of the registered query: labels with ``crc32 % FOLDS == HELD`` are held out; toxic from THRESHOLD on.
FOLDS, HELD, THRESHOLD = 3, 1, 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trained = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", FOLDS, HELD)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored(docs, trained).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go.

    Rows are judged by their text alone: repeated rows share a fate; null texts and those without words stay, as all
    do without labels of both classes. An empty table stays empty; all columns stay as they are.
    """
    trained = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", FOLDS, HELD)
    return without(docs, trained, THRESHOLD)
