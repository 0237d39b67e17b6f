"""Small awkward tables, and plain Python versions of what the contracts say."""

import random
import re
import zlib

WORDS = "the river ran over old stone and the mill wheel turned all night while rain fell on the roof of a house by the sea".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, `row` string, copies long, score double, `class` long, node long, label string, part int"


def table(spark, rows):
    """Documents (doc_id, text, source) with columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", s, len(t) if t is not None else None, 7, "k", "r", 3, 0.5, 9, 1, "l", 2) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows(seed=1, n=60):
    """Prose, near and exact copies, empty, blank and null texts, a very long one, repeated rows and null ids."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    out, base = [], [prose(rng.randrange(20, 120)) for _ in range(12)]
    for i in range(n):
        kind = i % 6
        words = rng.choice(base).split()
        if kind == 1:
            words[rng.randrange(len(words))] = f"new{i}"
        elif kind == 2:
            words = prose(rng.randrange(1, 80)).split()
        elif kind == 3:
            words = words[: max(1, int(len(words) * rng.choice([0.5, 0.8, 0.9])))]
        elif kind == 4:
            words = [w.upper() for w in words]
        out.append((i, (" " if i % 2 else "\n\t").join(words), rng.choice(["web", "books", "code", None])))
    out += [(100, None, "web"), (101, "", "web"), (102, " \n\t ", None), (103, "one two", "books"), (104, "One TWO", "books"), (105, "été 世界 naïve \U0001f600 x y z", "web")]
    out += [(106, prose(30_000), "web"), (107, "word " * 5000, "code"), out[0], out[0], (100, None, "web"), (None, base[0], "web"), (None, base[0], "web"), (None, None, None)]
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text):
    w = words(text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def classes(sets):
    """For each set the smallest number of a set reachable by links."""
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def auc(scores, labels):
    """Share of pairs in the right order, ties half."""
    import numpy as np

    s, y = np.asarray(scores, float), np.asarray(labels)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = int(y.sum())
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
