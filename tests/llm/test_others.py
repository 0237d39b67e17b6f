"""Url filters, vector searches and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import messy
from tests.llm.test_documents import check_sequences
from tilewright.llm import ann, quality, topk, toxicity, url_filter

# --- url filters


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = messy.lower(rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit)[2:] if fit else (None, default)
    return host, path, rule, verdict


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.com", "EXAMPLE.net", "a.example.net", "b.a.example.net", "notexample.net", "net", "x.org", "org", "", ".net", "example.net.", "example.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/a/b", "/fr/", "/fr", "?q=/en/", "#f", "/en/?x#y", "//en/", "/a/b/c"]
    urls = [f"{s}{h}{p}" for h in hosts for p in paths for s in ("http://", "ftp://")] + [None, "", "net/", "://", "a://b://net/", "http:///net/", "mailto:x@net"]
    rules = url_filter.RULES + [("example.net", "/en/x", "block"), ("b.a.example.net", "/e", "allow"), ("com", "", "block"), ("a.b", "/", "block"), ("example.com", "/de/a/b", "allow")]
    rng.shuffle(urls)
    rows = [(i, u, "<p>", "h", "r") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, host string, rule string")
    for use in (url_filter.RULES, rules):
        got = Counter(map(tuple, url_filter.url_filter(pages, url_filter.rules_table(spark, use)).collect()))
        assert got == Counter((i, *judged(u, use)) for i, u, *_ in rows + rows[:3])


def test_url_filter_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(none, url_filter.rules_table(spark, url_filter.RULES)).count() == 0
    page = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.url_filter(page, url_filter.rules_table(spark, [])).collect()] == [(1, "a", "/b", None, "allow")]


# --- vectors


def vectors(n, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[5:20] = x[4]  # ties
    rows = [(i, v.tolist(), 1, 0.0, 3) for i, v in enumerate(x)]
    rows += [(n, None, 1, 0.0, 3), (n + 50 - n % 50, [float("nan")] * dim, 1, 0.0, 3), (n + 1, [], 1, 0.0, 3), (n + 2, [None] * dim, 1, 0.0, 3), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1, 0.0, 3), (n + 4, [0.0] * dim, 1, 0.0, 3), (None, [1.0] * dim, 1, 0.0, 3)]
    return rows


VECTORS = "vec_id long, embedding array<float>, `block` int, score double, id long"


def brute(rows, k, measure, usable):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and usable(v)]
    out = {}
    for q, a in good:
        if q % 50 == 0:
            out[q] = sorted(((-measure(a, b), i) for i, b in good if i != q))[:k]
    return out


def test_top_k_equals_brute_force(spark):
    rows = vectors(2500)
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    expected = brute(rows, 5, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)), lambda v: True)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    assert got == {(q, k): (i, -s) for q, best in expected.items() for k, (s, i) in enumerate(best, 1)}


def test_top_k_in_several_groups_of_shards(spark, monkeypatch):
    rows = vectors(600)
    monkeypatch.setattr(topk, "GROUP", 1)
    monkeypatch.setattr(topk.V, "BLOCK", 100)
    expected = brute(rows, 5, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)), lambda v: True)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {(q, k): (i, -s) for q, best in expected.items() for k, (s, i) in enumerate(best, 1)}


def test_top_k_visits_few_leaves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    search = topk.Search(np.arange(10), topk.quantised(x[:10] * 50, 256), 5)
    search.shard(np.arange(4000), topk.quantised(x, 256))
    assert search.visited < 10 * 4000 / topk.LEAF / 3


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()} == {(0, 1, 50, 65536), (0, 2, 3, 0), (50, 1, 0, 65536), (50, 2, 3, 0)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect()} == {(0, 1, 50, 1.0), (0, 2, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 0.0)}
    assert topk.top_k(df.limit(0)).count() == 0 and ann.nearest(df.limit(0)).count() == 0


def cosine(a, b):
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def test_nearest_recall_and_scores(spark):
    rows = vectors(4000, 16)
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    expected = brute(rows, 5, cosine, any)
    by_id = {i: np.array(v, float) for i, v, *_ in rows if v and i is not None}
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        assert r.score == pytest.approx(cosine(by_id[r.query_id], by_id[r.vec_id]), abs=1e-12)
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in best}) for q, best in expected.items())
    assert hits / sum(map(len, expected.values())) >= 0.9
    for found in got.values():
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in sorted(found)] == sorted((s for _, _, s in found), reverse=True)


def test_nearest_recall_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    score = x[ids % 50 == 0] @ x.T
    got = defaultdict(set)
    for r in ann.query(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, s in zip(ids[ids % 50 == 0].tolist(), score, strict=True):
        s[ids == q] = -2
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    recall = hits / (5 * len(score))
    print("recall", recall)
    assert recall >= 0.9


# --- pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for _, f in corpus_pipeline.STAGES:
        tables.append(f(spark, tables[-1], sf_dir).cache())
    clean, good, once, mixed, packed = tables[1:]
    rows = lambda t: sorted(map(tuple, t.collect()), key=repr)
    for t in (clean, good, once, mixed):
        assert t.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.query(spark, sf_dir).collect() if r.predicted}
    assert rows(clean) == rows(docs.where(~docs.doc_id.isin(list(toxic))))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    low = {r.doc_id for r in quality.scored(clean, quality.train(clean, labels)).collect() if r.score < quality.THRESHOLD}
    assert rows(good) == rows(clean.where(~clean.doc_id.isin(list(low))))
    had = good.collect()
    found = messy.classes([messy.shingles(r.text) for r in had])
    first = {}
    for c, r in zip(found, had, strict=True):
        if messy.shingles(r.text):
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    expected = set(first.values()) | {r.doc_id for r in had if not messy.shingles(r.text)}
    assert sorted(r.doc_id for r in once.collect()) == sorted(expected)
    assert {r.doc_id for r in mixed.collect()} <= expected
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    check_sequences(packed.collect(), 2048)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
