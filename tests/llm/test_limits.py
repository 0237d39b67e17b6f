"""The ways beyond each limit: rules, keys and classes that are not broadcast, and many shards of packing."""

from collections import Counter

import pytest

from tests.llm import messy
from tests.llm.test_documents import check_sequences
from tests.llm.test_others import judged
from tilewright.llm import jaccard, packing, quality, toxicity, url_filter


def test_rules_joined_by_shuffle_and_rules_without_a_host_or_path(spark, monkeypatch):
    hosts = ["a.example.net", "example.com", "net", "x.org", "NET"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/x", "/de/", "/fr/a?b")] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*url_filter.RULES, (None, "/", "block"), ("net", None, "block"), ("example.com", "", "block")]
    expected = Counter((i, *judged(u, [r for r in rules if None not in r])) for i, u in enumerate(urls))
    for most in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        assert Counter(map(tuple, url_filter.url_filter(pages, url_filter.rules_table(spark, rules)).collect())) == expected


def test_classes_with_all_keys_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "HOT", 4)
    rows = messy.rows(8)
    sets = [messy.shingles(t) for _, t, _ in rows]
    found = messy.classes(sets)
    least = {}
    for c, (i, _, _) in zip(found, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = Counter((i, len(s), least.get(c) if s else i) for c, s, (i, _, _) in zip(found, sets, rows, strict=True))
    docs = messy.table(spark, rows)
    assert Counter(map(tuple, jaccard.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect())) == expected
    kept = jaccard.stage_function(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len({c for c, s in zip(found, sets, strict=True) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize("rows", [50, 200])
def test_each_shard_wastes_about_one_sequence(spark, monkeypatch, rows):
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(messy.WORDS) for _ in range(rng.randrange(1, 300)))) for i in range(1000)], "doc_id long, text string")
    monkeypatch.setattr(packing, "SHARD_ROWS", rows)
    packed = packing.pack_documents(docs, 512).collect()
    check_sequences(packed, 512, slack=0.2)
    total, used = sum(r.length for r in packed), len({r.sequence_id for r in packed})
    assert sorted({r.doc_id for r in packed}) == list(range(1000))
    assert used <= -(-total // 512) * 1.02 + 2 * -(-len(packed) // rows)


def test_memory_of_a_tokenizing_worker():
    """Some five megabytes of words of which hardly any occurs twice; numpy's arrays and Python's objects count."""
    import random
    import tracemalloc

    import numpy as np
    import public_tokenizers as public

    from tilewright.llm import flat

    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(600)).encode() for _ in range(1000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    flat._powers.cache_clear()
    tokenizer = packing.StretchTokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    tracemalloc.start()
    try:
        for _, _, part, off in flat.runs(data, offsets, packing.RUN):
            ids, at = tokenizer.encode_run(part, off, 0)
            assert len(at) == len(off) and at[-1] == len(ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6, peak


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_more_labels_than_are_broadcast(spark, monkeypatch, module, column):
    rows = [(i, f"{'vile bad' if i % 3 == 0 else 'kind good'} words {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], f"doc_id long, {column} int")
    scores = lambda: {r.doc_id: round(r.score, 9) for r in module.scored(docs, module.train(docs, labels, column)).collect()}
    before = scores()
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert scores() == before
