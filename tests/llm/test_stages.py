"""Token counts, the quality classifier and the pipeline's stages against plain Python, on awkward tables."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import messy
from tests.llm.test_documents import check_sequences
from tilewright.llm import packing, quality, token_counts, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of an awkward table of documents, with labels for some."""
    at = str(tmp_path_factory.mktemp("awkward"))
    messy.table(spark, messy.rows()).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, i // 2 % 2) for i in range(60)] + [(1, 0, 0), (None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    """The same without documents."""
    at = str(tmp_path_factory.mktemp("nothing"))
    messy.table(spark, messy.rows()).limit(0).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


# --- token counts


def vocabulary_path():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken")


def test_token_counts_by_the_real_vocabulary(spark, folder, nothing):
    vocabulary = set(token_counts.vocabulary_of(vocabulary_path()))
    most = max(map(len, vocabulary))
    known = {}

    def greedy(word):
        if word not in known:
            n, at, data = 0, 0, b" " + word.encode()
            while at < len(data):
                at += next(k for k in range(most, 0, -1) if at + k <= len(data) and data[at : at + k] in vocabulary)
                n += 1
            known[word] = n
        return known[word]

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got = Counter(map(tuple, token_counts.token_counts(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary_path()).collect()))
    assert got == Counter((i, len(split(t)), sum(map(greedy, split(t)))) for i, t, _ in messy.rows())
    assert token_counts.token_counts(spark.read.parquet(f"{nothing}/documents.parquet"), vocabulary_path()).count() == 0


def test_words_of_all_lengths_are_counted_alike(monkeypatch):
    rng = random.Random(3)
    automaton = token_counts.Automaton(token_counts.vocabulary_of(vocabulary_path()))
    texts = ["".join(rng.choice(messy.WORDS) for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    counts = []
    for few in (0, 200, 10**6):
        monkeypatch.setattr(token_counts, "FEW", few)
        counts.append(automaton.counts(data, ends - [len(t) for t in texts], ends).tolist())
    assert counts[0] == counts[1] == counts[2]


def test_a_word_of_megabytes_takes_seconds():
    automaton = token_counts.Automaton(token_counts.vocabulary_of(vocabulary_path()))
    data = np.frombuffer(("".join(messy.WORDS) * 40_000).encode(), np.uint8)
    begun = time.monotonic()
    count = automaton.counts(data, np.array([0]), np.array([len(data)]))
    assert len(data) > 3_000_000 and len(data) / 8 < count[0] < len(data) and time.monotonic() - begun < 60


# --- quality classifier


def test_ftrl_equals_plain_updates():
    rng = random.Random(4)
    rows = [(label, k, np.array([rng.random() * 4 for _ in k])) for label in (0, 1) * 60 for k in [np.array(rng.sample(range(30), rng.randrange(0, 8)) + [100 + label], np.int64)]]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for label, k, x in rows:
            x = {**dict(zip(k.tolist(), x, strict=True)), 1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = dict(zip(*(a.tolist() for a in quality.ftrl(rows)), strict=True))
    expected = {i: weight(i) for i in z if weight(i)}
    assert set(got) == set(expected) and all(got[i] == pytest.approx(expected[i], rel=1e-9) for i in got)


def test_features_and_scores_equal_plain_ones():
    texts = [t for _, t, _ in messy.rows()] + ["a a a  b", "x,,y ,, x", "!! !! été"]
    names, weights, expected = {}, np.random.default_rng(5).normal(size=(1 << quality.BITS) + 1), []
    for t in texts:
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (t or "").encode())
        tokens = [None if i and tokens[i - 1] == x else x for i, x in enumerate(tokens)]
        grams = [(x,) for x in tokens] + list(zip(tokens, tokens[1:], strict=False))
        data = np.frombuffer((t or "").encode(), np.uint8)
        index, doc, n = quality.features(data, np.array([0, len(data)]))
        assert len(index) == len(grams) and n.tolist() == [len(tokens)] and not doc.any()
        assert all(names.setdefault(g, i) == i for g, i in zip(grams, index.tolist(), strict=True))
        value = sum(weights[names[g]] for g in grams) * quality.SCALE / max(len(tokens), 1) + weights[-1]
        expected.append(1 / (1 + math.exp(-min(max(value, -35), 35))))
    assert quality.scores(pa.array(texts), weights) == pytest.approx(expected, abs=1e-9)


def test_texts_of_an_id_are_bounded(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(messy.WORDS) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["!!", "buy", "now", "$$"]) for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(100)] + [(2, bad()) for _ in range(3000)] + [(3, good())] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert (weights == quality.train(docs.repartition(7), labels)).all()
    rows = quality.scored(docs, weights).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows) and len(rows) == 6100


# --- stages of the pipeline


@pytest.mark.parametrize("module", [quality, toxicity])
def test_filtering_stages_keep_whole_rows(spark, folder, nothing, module):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = module.stage_function(spark, docs, folder)
    assert kept.schema == docs.schema
    trained = module.train(docs, labels)
    score = {r.doc_id: r.score for r in module.scored(docs, trained).collect()}
    stays = (lambda s: s >= quality.THRESHOLD) if module is quality else (lambda s: s < toxicity.THRESHOLD)
    named = Counter(r for r in docs.collect() if r.doc_id is not None)
    expected = Counter({r: k for r, k in named.items() if stays(score[r.doc_id])})
    assert Counter(r for r in kept.collect() if r.doc_id is not None) == expected
    none = spark.read.parquet(f"{nothing}/documents.parquet")
    assert module.stage_function(spark, none, nothing).collect() == []


def test_packing_stage(spark, folder, nothing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.stage_function(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _, _ in messy.rows())
    check_sequences(rows, packing.CAPACITY)
    assert packing.stage_function(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).count() == 0


def test_pipeline_of_awkward_and_empty_tables(spark, folder, nothing):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {i for i, _, _ in messy.rows()} and rows
    check_sequences(rows, packing.CAPACITY)
    assert corpus_pipeline.run(spark, nothing).count() == 0
