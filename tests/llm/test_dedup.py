"""Exact dedup: against a plain dictionary of normalised texts, with huge texts in parts and clashing fingerprints."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import messy
from tilewright.llm import dedup


def plain(rows):
    """(id, keep id, size, sha) of each row, and how many rows of each text stay."""
    of = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        of[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = of[norm(t)]
        named = [x for x in ids if x is not None]
        out.append((i, min(named) if named else None, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out, len(of)


def check(df, rows, **options):
    expected, texts = plain(rows)
    got = dedup.exact_dedup(df, **options).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected, key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == texts == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)


def awkward():
    rows = [(i, t) for i, t, _ in messy.rows(4)]
    base = rows[0][1]
    rows += [(500 - i, base.replace(" ", " \r\n" if i % 2 else "\t")) for i in range(60)]
    rows += [(600, " " + base), (601, base + "\x0b\x0c"), (602, base + " "), (603, " " + base), (604, "a\0b"), (605, "a\0b "), (606, "")]
    return rows


@pytest.mark.parametrize("options", [{}, {"size": 64}, {"primes": (101, 103)}, {"primes": (101, 103), "size": 1000}])
def test_dedup_equals_brute_force(spark, monkeypatch, options):
    rows = awkward()
    df = messy.table(spark, [(i, t, "web") for i, t in rows]).repartition(5)
    check(df, rows, **options)
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    check(df, rows, **options)


def test_prints_of_chunks_add_up_to_those_of_the_whole():
    data = np.random.default_rng(3).integers(0, 256, 10_000).astype(np.uint8)
    for base, prime, k in zip(dedup.BASES, dedup.PRIMES, range(2), strict=True):
        whole = sum(int(b) * pow(base, i, prime) for i, b in enumerate(data)) % prime
        cuts = np.array([0, 1, 1, 4096, 9000, 10_000])
        got = dedup.chunk_prints(data, cuts, cuts[:-1])
        assert int(got[k].sum()) % prime == whole
        assert dedup.chunk_prints(data, np.array([0, 10_000]), np.array([0]))[k][0] == whole


def test_rows_keep_their_columns(spark):
    rows = [(i, t, "web") for i, t in awkward()]
    df = messy.table(spark, rows)
    out = dedup.exact_dedup(df, keep=df.columns)
    kept = out.where("kept").select("row.*")
    assert kept.columns == df.columns and kept.count() == out.select("text_sha256").distinct().count()
    assert kept.exceptAll(df).count() == 0
    assert dedup.exact_dedup(df.limit(0)).count() == 0
