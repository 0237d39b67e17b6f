"""Periodic runs: against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import messy
from tilewright.llm import periods


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_period(w):
    """By the failure function of the word sequence."""
    f = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = f[k - 1]
        k += w[i] == w[k]
        f[i] = k
    return len(w) - f[-1]


def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and smallest_period(w[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def sequences(seed, n=120):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        letters = "ab" if t % 3 == 0 else "abcdefgh" if t % 3 == 1 else [f"w{k}" for k in range(300)]
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(4)):
            base = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 12, 13, 18, 19, 27, 40, 61, 90]))]
            if rng.random() < 0.4:  # a period made of periods
                base = base * rng.randrange(1, 4) + [rng.choice(letters)]
            size = int(len(base) * rng.choice([2, 2.9, 3, 3.1, 4, 5.5])) + rng.randrange(3)
            w += [base[i % len(base)] for i in range(size)]
            if rng.random() < 0.3 and w:
                w[rng.randrange(len(w))] = rng.choice(letters)
            w += [rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 30]))]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    docs = sequences(seed)
    ids = {}
    x = np.array([ids.setdefault(v, len(ids)) for w in docs for v in w])
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
    of, start, length, period = periods.find_runs(x, offsets)
    got = [[] for _ in docs]
    for d, *r in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append(tuple(r))
    assert got == [plain_runs(w) for w in docs]
    assert sum(map(len, got)) > 50


def test_every_period_is_found():
    rng = np.random.default_rng(1)
    for q in [*range(1, 60), 99, 100, 101, 333, 1000, 2047]:
        noise = rng.integers(10_000, 20_000, 50)
        base = np.arange(q)
        n = max(24, 3 * q)
        x = np.concatenate([noise, base[np.arange(n) % q], noise[::-1]])
        assert [v.tolist() for v in periods.find_runs(x, np.array([0, len(x)]))] == [[0], [50], [n], [q]]
        x = np.delete(x, 50)
        assert not len(periods.find_runs(x, np.array([0, len(x)]))[0])


def test_sequences_without_cubes_and_with_all():
    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 14)])
    assert not len(periods.find_runs(bits, np.array([0, len(bits)]))[0])
    same = np.zeros(50_000, np.int64)
    assert [v.tolist() for v in periods.find_runs(same, np.array([0, 20, 50_000]))] == [[1], [0], [49_980], [1]]


def test_a_clash_of_hashes_is_found_out(monkeypatch):
    """With hashes that say everything is equal, only what words confirm is left."""
    docs = sequences(9, 30)
    ids = {}
    x = np.array([ids.setdefault(v, len(ids)) for w in docs for v in w])
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
    monkeypatch.setattr(periods.Prefixes, "of", lambda self, start, length: start * 0)
    of, start, length, period = periods.find_runs(x, offsets)
    truth = {(d, *r) for d, w in enumerate(docs) for r in plain_runs(w)}
    assert {*zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True)} <= truth


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, t, s) for i, t, s in messy.rows(6)]
    for k, w in enumerate(sequences(11, 200)):
        rows.append((1000 + k, rng.choice([" ", "\n", "\t \r"]).join(w) + " " * (k % 2), "web"))
    rows = [r for r in rows if len(split(r[1])) < 4000]  # the plain search is quadratic
    messy.table(spark, rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, t, _ in rows:
        w = plain_planted(i, split(t))
        found = plain_runs(w)
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        milli = 1000 * top[1] // top[2] if top else None
        expected.append((i, len(found), *(top or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()))
    got = [tuple(r) for r in periods.query(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(r[1] for r in expected) > 100


def test_runs_of_nothing_and_of_long_texts(spark):
    df = messy.table(spark, [(1, "word " * 200_000, "web"), (2, None, None), (3, " ".join(f"a{i % 7000}" for i in range(21_000)), "web")])
    got = {r.row.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect()}
    assert got[1] == ([(0, 200_000, 1)], "word") and got[2] == ([], "")
    assert got[3] == ([(0, 21_000, 7000)], " ".join(f"a{i}" for i in range(7000)))
    assert periods.periodic_runs(df.limit(0)).count() == 0
    assert periods.periodic_runs(df, ["doc_id", "row", "key"]).select("row.*").columns == ["doc_id", "row", "key"]
