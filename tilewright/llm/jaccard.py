"""N-gram Jaccard join over all documents with a token-group matrix; exact.

A document's set holds 64-bit hashes of its distinct word shingles. Steps, each over the whole table:

1. A shingle that no other set holds helps no link, and two sets link only if each shares three quarters of itself (at
   the usual threshold). Chunks of documents send their distinct shingles to hash ranges, which return for each
   document how many others hold too. Documents that share too little are done; most are.
2. For the rest, hash ranges count in how many sets each shingle is. Sets are ordered rarest shingle first; the prefix
   that some partner must meet is kept as postings (shingle, set, size, what remains from there on).
3. Groups: on each shingle every set is compared with one hub, the one that shares most of itself. Components of the
   links found are groups of similar documents.
4. Token-group matrix: for each shingle, group and size step, the union of its members' postings with the range of
   sizes and the most that remains. What remains of a query set from a shingle on also limits how large a partner can
   be, so a set meets only groups of the size steps that it can reach: of thousands of unlike documents on one shingle
   few meet. For groups that this leaves, the query's shingles found in the union of all shingles of the group are
   summed: no member can share more. Only groups whose sum reaches the need are opened, and their members compared.

Hash ranges count the 32 bits after the range's own, within the upper 48 bits of a shingle's hash: a clash makes a
shingle look shared, which costs work, not links. Shingles are compared by 64-bit hashes, sets named by 63-bit ones and
rows by 64-bit ones, so results are exact up to clashes of those: at 1e10 different sets, some five of them.

Keys that hold a ``HOT``-th of all rows, as a class of copies may, are joined by a broadcast of at most ``HOT`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.flat import NOT_SPACE, flat, in_small_batches, mix, runs, span_hashes, spans
from tilewright.session import stage

#: Words of a shingle; a link needs PERCENT * union <= 100 * intersection.
WORDS, PERCENT = 5, 75
#: A chunk ends after so many shingles or documents; a hash range holds about so many shingles.
CHUNK_SHINGLES, CHUNK_DOCS, RANGE_SHINGLES = 1 << 21, 60_000, 1 << 21
#: Row keys up to this many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Keys with at least this share (one of so many) of a table's rows are joined by broadcast.
HOT = 1000
#: Logarithm of the ratio of two size steps.
STEP = math.log(1.15)
#: Owner of a shingle that several documents of its chunk hold.
MANY = 0xFFFF

_HEAD = np.dtype([("id", "i8"), ("null", "u1"), ("key", "i8"), ("n", "i8"), ("sig", "i8"), ("own", "i8")])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs (first text, shingles of each text sorted and distinct, end of each text's among them)."""
    data, offsets = flat(texts)
    for i, j, part, off in runs(data, offsets):
        starts, ends, doc = spans(NOT_SPACE[part], off)
        h = span_hashes(part, starts, ends)
        count = np.bincount(doc, minlength=j - i)
        first = np.cumsum(count) - count
        per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        at = np.repeat(first - np.cumsum(per) + per, per) + np.arange(int(per.sum()))
        short = np.repeat(count, per)
        x = np.zeros(len(at), np.uint64)
        for k in range(words):
            in_text = k < short
            x = np.where(in_text, mix(x ^ h[np.minimum(at + k, len(h) - 1)]), x) if len(h) else x
        edge = np.cumsum(per)
        for a, b in zip((edge - per)[per > 1].tolist(), edge[per > 1].tolist(), strict=True):
            x[a:b].sort()
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        new[(edge - per)[per > 0]] = True
        total = np.concatenate([[0], np.cumsum(new)])
        yield i, x[new], total[edge]


def signatures(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each set; equal sets have equal ones."""
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x + np.uint64(1)), dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]])
    return (mix((c[ends] - c[starts]) ^ (ends - starts).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _split(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes as edges of 2**bits ranges, and the 32 bits that follow the range's."""
    edges = np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.concatenate([[0], edges, [len(x)]]), (x >> np.uint64(32 - bits)).astype(np.uint32)


_SENT = "part long, chunk long, body binary, more binary"


def _rows(part, chunk, body, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary()), pa.array(more, pa.binary())], ["part", "chunk", "body", "more"])


def _send_chunks(words: int, bits: int):
    """Rows (key, doc_id, text) to one header row a chunk, and a row for each hash range with the chunk's shingles and their owners."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        heads, xs, owners, docs, size, done = [], [], [], 0, 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal docs, size, done
            head, x, owner = np.concatenate(heads), np.concatenate(xs), np.concatenate(owners)
            packed = np.sort((x & ~np.uint64(0xFFFF)) | owner.astype(np.uint64))
            x, owner = packed & ~np.uint64(0xFFFF), (packed & np.uint64(0xFFFF)).astype(np.int64)
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            single = new.copy()
            single[:-1] &= new[1:]
            head["own"] = np.bincount(owner[~single], minlength=len(head))
            owner = np.where(single, owner, MANY)[new].astype(np.uint16)
            edges, low = _split(x[new], bits)
            chunk = (TaskContext.get().partitionId() << 24) + done
            keep = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
            out = _rows([-1 - chunk] + keep, [chunk] * (1 + len(keep)), [head.tobytes()] + [low[edges[b] : edges[b + 1]].tobytes() for b in keep], [None] + [owner[edges[b] : edges[b + 1]].tobytes() for b in keep])
            heads.clear(), xs.clear(), owners.clear()
            docs, size, done = 0, 0, done + 1
            return out

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).cast(pa.int64())
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, x, ends in shingle_sets(batch.column(2), words):
                n = np.diff(ends, prepend=0)
                m = len(n)
                if docs + m > CHUNK_DOCS and docs:
                    yield emit()
                for a in range(0, m, CHUNK_DOCS):
                    b = min(m, a + CHUNK_DOCS)
                    if a:
                        yield emit()
                    head = np.zeros(b - a, _HEAD)
                    head["id"], head["null"], head["key"], head["n"] = ids[i + a : i + b], null[i + a : i + b], keys[i + a : i + b], n[a:b]
                    head["sig"] = signatures(x, ends)[a:b]
                    # Equal sets of a chunk count as one holder.
                    _, one = np.unique(head["sig"], return_index=True)
                    holds = np.zeros(b - a, bool)
                    holds[one] = True
                    per = np.where(holds, n[a:b], 0)
                    mask = np.repeat(holds, n[a:b])
                    heads.append(head)
                    xs.append(x[(ends[a] - n[a]) : ends[b - 1]][mask])
                    owners.append(np.repeat(np.arange(docs, docs + b - a), per))
                    docs, size = docs + b - a, size + int(per.sum())
                if size >= CHUNK_SHINGLES:
                    yield emit()
        if docs:
            yield emit()

    return send


def _count_shared(rows: pa.Table) -> pa.Table:
    """Of one hash range: for each chunk, which documents hold how many shingles that another chunk holds too."""
    if rows.column("part")[0].as_py() < 0:
        return rows
    chunks = rows.column("chunk").to_pylist()
    low = [np.frombuffer(b, np.uint32) for b in rows.column("body").to_pylist()]
    owner = np.concatenate([np.frombuffer(b, np.uint16) for b in rows.column("more").to_pylist()]).astype(np.int64)
    at = np.repeat(np.arange(len(low)), [len(x) for x in low])
    x = np.concatenate(low)
    order = np.argsort(x, kind="stable")
    s = x[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    hit = order[twice]
    hit = hit[owner[hit] != MANY]
    which, count = np.unique(at[hit] << 16 | owner[hit], return_counts=True)
    edges = np.searchsorted(which, np.arange(len(low) + 1) << 16)
    full = [k for k in range(len(low)) if edges[k] < edges[k + 1]]
    return pa.Table.from_batches([_rows([0] * len(full), [chunks[k] for k in full], [(which[edges[k] : edges[k + 1]] & 0xFFFF).astype(np.uint16).tobytes() for k in full], [count[edges[k] : edges[k + 1]].astype(np.uint32).tobytes() for k in full])])


_DOC = "doc_id long, row_key long, n_shingles long, sig long, shared long"


def _gather_shared(rows: pa.Table) -> pa.Table:
    """Of one chunk: its documents with the number of shingles that another set may hold."""
    head, counts = None, []
    for part, body, more in zip(*(rows.column(c).to_pylist() for c in ("part", "body", "more")), strict=True):
        if part < 0:
            head = np.frombuffer(body, _HEAD)
        else:
            counts.append((np.frombuffer(body, np.uint16), np.frombuffer(more, np.uint32)))
    shared = head["own"].astype(np.int64)
    for owner, count in counts:
        shared[owner] += count
    # Of equal sets only the first was counted.
    _, first, which = np.unique(head["sig"], return_index=True, return_inverse=True)
    shared = shared[first][which]
    values = [pa.array(head["id"].copy(), mask=head["null"].astype(bool)), *(pa.array(head[c].copy()) for c in ("key", "n", "sig")), pa.array(shared)]
    return pa.Table.from_arrays(values, ["doc_id", "row_key", "n_shingles", "sig", "shared"])


_SET_HEAD = np.dtype([("sig", "i8"), ("n", "i8")])


def _send_sets(bits: int):
    """Sets (sig, n, shingles) to a header a chunk, which holds them whole, and a row for each hash range with distinct shingles and their counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for done, batch in enumerate(batches):
            head = np.zeros(batch.num_rows, _SET_HEAD)
            head["sig"], head["n"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shingles = b"".join(batch.column(2).to_pylist())
            x, counts = np.unique(np.frombuffer(shingles, np.uint64), return_counts=True)
            edges, low = _split(x, bits)
            counts = counts.astype(np.uint32)
            chunk = (TaskContext.get().partitionId() << 24) + done
            keep = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
            yield _rows([-1 - chunk] + keep, [chunk] * (1 + len(keep)), [head.tobytes()] + [low[edges[b] : edges[b + 1]].tobytes() for b in keep], [shingles] + [counts[edges[b] : edges[b + 1]].tobytes() for b in keep])

    return send


def _sum_counts(rows: pa.Table) -> pa.Table:
    """Of one hash range: for each chunk's shingles, in their order, the number of sets of all chunks."""
    part = rows.column("part")[0].as_py()
    if part < 0:
        return rows
    low = [np.frombuffer(b, np.uint32) for b in rows.column("body").to_pylist()]
    count = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("more").to_pylist()])
    _, which = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(which, count)[which].astype(np.uint32)
    edges = np.cumsum([0] + [len(x) for x in low])
    return pa.Table.from_batches([_rows([part] * len(low), rows.column("chunk").to_pylist(), [total[edges[k] : edges[k + 1]].tobytes() for k in range(len(low))], [None] * len(low))])


_POSTING = "token long, sig long, n long, remains long"


def _postings(percent: int):
    """Of one chunk: prefix postings of its sets, for shingles of at least two sets, rarest shingle first."""

    def make(rows: pa.Table) -> pa.Table:
        head, counts = None, []
        for part, body, more in sorted(zip(*(rows.column(c).to_pylist() for c in ("part", "body", "more")), strict=True), key=lambda r: r[0]):
            if part < 0:
                head, x = np.frombuffer(body, _SET_HEAD), np.frombuffer(more, np.uint64)
            else:
                counts.append(np.frombuffer(body, np.uint32))
        _, which = np.unique(x, return_inverse=True)
        df = np.concatenate(counts)[which] if counts else np.zeros(0, np.uint32)
        n = head["n"]
        doc = np.repeat(np.arange(len(head)), n)
        order = np.lexsort((x, df, doc))
        remains = n[doc] - (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        need = -(-percent * n // 100)  # what any partner shares at least
        keep = (remains >= need[doc]) & (df[order] >= 2)
        values = [x[order][keep].astype(np.int64), head["sig"][doc[keep]], n[doc[keep]], remains[keep]]
        return pa.Table.from_arrays([pa.array(v) for v in values], ["token", "sig", "n", "remains"])

    return make


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, n, other, shingles) to a row for each shingle."""
    for batch in batches:
        blobs = batch.column(3).to_pylist()
        at = pa.array(np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]))
        token = pa.array(np.frombuffer(b"".join(blobs), np.int64))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], token], ["sig", "n", "other", "token"])


def _verify(percent: int):
    """Pairs (a, b, their shingles) to the links among them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _bits(shingles: int, least: int) -> int:
    return max(1, max(least, -(-shingles // RANGE_SHINGLES)) - 1).bit_length()


def _joined(left: DataFrame, key: str, right: DataFrame) -> DataFrame:
    """``left`` joined on ``key``, as a left join, to ``right``, which has one row for a key. ``left`` is a staged table.

    Rows of a hot key are not shuffled; as each such key holds a HOT-th of the rows, there are HOT of them at most.
    """
    n = left.count()
    hot = stage(left.groupBy(key).count().where(F.col("count") * HOT >= n).select(key).join(right, key, "left"), "hot-keys")
    few = F.broadcast(hot)
    return left.join(few, key).union(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, "left"))


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents of ``docs`` (doc_id, text) with their class: (doc_id, row_key, n_shingles, sig, class), staged.

    row_key is a hash of doc_id and text; sig one of the set. A set has a text's distinct shingles of ``words`` words
    (A-Z lower-cased); with fewer words, all of them as one; a null text or one without words has none and a null
    class, for it links with nothing. Documents have the same class if links join them. Null ids take part like others;
    repeated rows stay repeated and share a class. Other columns are not read.
    """
    spark = docs.sparkSession
    keyed = in_small_batches(docs).select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    least = 2 * spark.sparkContext.defaultParallelism
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sent = keyed.mapInArrow(_send_chunks(words, _bits(size // 6, least)), _SENT)
    known = stage(sent.groupBy("part").applyInArrow(_count_shared, _SENT).groupBy("chunk").applyInArrow(_gather_shared, _DOC), "jaccard-docs")

    reps = stage(known.where(f"n_shingles > 0 and 100 * shared >= {percent} * n_shingles").groupBy("sig").agg(F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n")), "jaccard-left")
    rows, shingles = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys = reps.select("row_key")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, ends in shingle_sets(batch.column(0), words):
                starts = np.concatenate([[0], ends[:-1]])
                blobs = [x[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signatures(x, ends)), pa.array(ends - starts), pa.array(blobs, pa.binary())], ["sig", "n", "shingles"])

    left = keyed.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, "row_key", "left_semi").select("text")
    sets = stage(left.mapInArrow(sets_of, "sig long, n long, shingles binary").dropDuplicates(["sig"]), "jaccard-sets")
    counted = sets.mapInArrow(_send_sets(_bits(shingles, least)), _SENT).groupBy("part").applyInArrow(_sum_counts, _SENT)
    postings = stage(counted.groupBy("chunk").applyInArrow(_postings(percent), _POSTING), "jaccard-postings")

    need = lambda n, m: F.ceil((n + m) * percent / F.lit(100 + percent))
    fits = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))

    def links(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("sig").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
        return pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(_verify(percent), "a long, b long")

    hubs = postings.groupBy("token").agg(F.max_by(F.struct(F.col("sig").alias("hub"), F.col("n").alias("hub_n"), F.col("remains").alias("hub_remains")), F.struct(F.col("remains") / F.col("n"), "n", "sig")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", "h.*")
    stars = postings.join(hubs, "token").where((F.col("sig") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")) & (F.least("remains", "hub_remains") >= need(F.col("n"), F.col("hub_n"))))
    first = stage(links(stars.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))), "jaccard-stars")
    group = components(first)

    step = lambda n: F.floor(F.log(n) / F.lit(STEP)).cast("int")
    member = stage(postings.join(group, postings["sig"] == group["node"], "left").select(*postings.columns, F.coalesce("label", "sig").alias("group")), "jaccard-members")
    many = member.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g <> h").select("token")
    shared = stage(member.join(many, "token", "left_semi").withColumn("step", step(F.col("n"))), "jaccard-shared")
    matrix = shared.groupBy("token", F.col("group").alias("other"), "step").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("remains").alias("most_remains"))
    # A partner of m shingles fits and needs no more than remains: (n + m) * percent / (100 + percent) <= remains.
    low = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / F.lit(100) - F.lit(1e-6)))
    high = F.least(F.floor(F.col("n") * 100 / F.lit(percent) + F.lit(1e-6)), F.floor(F.col("remains") * (100 + percent) / F.lit(percent) + F.lit(1e-6)) - F.col("n"))
    reach = (100 * F.col("n") >= percent * F.col("least_n")) & (100 * F.col("most_n") >= percent * F.col("n")) & (F.least("remains", "most_remains") >= need(F.col("n"), F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / F.lit(100)))))
    asks = shared.where(high >= low).drop("step").withColumn("step", F.explode(F.sequence(step(low), step(high))))
    opened = asks.join(matrix, ["token", "step"]).where((F.col("group") != F.col("other")) & reach).select("token", "step", "sig", "n", "remains", "other")
    opened = stage(opened, "jaccard-opened")
    # Overlap of a query with a group: its shingles in the union of the group's, one row for each.
    asking = stage(opened.select("sig", "n", "other").distinct(), "jaccard-asking")
    of_query = asking.join(sets.select("sig", "shingles"), "sig").select("sig", "n", "other", "shingles").mapInArrow(_tokens, "sig long, n long, other long, token long")
    grouped = sets.join(group, sets["sig"] == group["node"], "left").select(F.coalesce("label", "sig").alias("other"), "shingles")
    asked = grouped.join(asking.select("other").distinct(), "other", "left_semi")
    of_group = asked.select("other", "other", "other", "shingles").toDF("sig", "n", "other", "shingles").mapInArrow(_tokens, "sig long, n long, other long, token long").select("other", "token").distinct()
    overlap = of_query.join(of_group, ["other", "token"]).groupBy("sig", "n", "other").count()
    reached = stage(overlap.where(100 * F.col("count") >= percent * F.col("n")).select("sig", "other"), "jaccard-reached")
    opened = opened.join(reached, ["sig", "other"], "left_semi")
    inside = shared.select("token", "step", F.col("sig").alias("m"), F.col("n").alias("m_n"), F.col("remains").alias("m_remains"), F.col("group").alias("other"))
    pairs = opened.join(inside, ["token", "step", "other"]).where((F.col("sig") < F.col("m")) & fits(F.col("n"), F.col("m_n")) & (F.least("remains", "m_remains") >= need(F.col("n"), F.col("m_n"))))
    second = links(pairs.select(F.col("sig").alias("a"), F.col("m").alias("b")))
    label = components(first.union(second))
    named = _joined(known.where("n_shingles > 0"), "sig", label.withColumnRenamed("node", "sig")).select("doc_id", "row_key", "n_shingles", "sig", F.coalesce("label", "sig").alias("class"))
    return stage(named.union(known.where("n_shingles = 0").select("doc_id", "row_key", "n_shingles", "sig", F.lit(None).cast("long").alias("class"))), "jaccard-classes")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id of the document's class, for each row of ``docs``.

    A document that links with nothing is its own component. Null ids never name a component; a class of null ids
    alone, or an unlinked null id, has a null component_id. See ``jaccard_classes`` for the rest.
    """
    classes = jaccard_classes(docs, words, percent)
    linked = classes.where("class is not null")
    joined = _joined(linked, "class", linked.groupBy("class").agg(F.min("doc_id").alias("component_id"))).select("doc_id", "n_shingles", "component_id")
    return joined.union(classes.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, that with the smallest doc_id (nulls last, then by a hash of
    the text); documents without words all stay. Of rows equal in doc_id and text one stays."""
    classes = jaccard_classes(docs).where("class is not null")
    best = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("best")).select("class", F.col("best.row_key").alias("stays"))
    judged = _joined(classes, "class", best).groupBy("row_key").agg(F.max(F.col("row_key") == F.col("stays")).alias("stays"), F.count("*").alias("rows"))
    gone = stage(judged.where("not stays").select("row_key"), "jaccard-gone")
    twice = stage(judged.where("stays and rows > 1").select("row_key"), "jaccard-repeated")
    hint = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), row).join(hint(gone), "row_key", "left_anti")
    once = rows.join(hint(twice), "row_key", "left_anti")
    again = rows.join(hint(twice), "row_key", "left_semi").groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*").union(again.select("row.*"))


SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d
), t as (
  select doc_id, len(g) as n, unnest(g) as x from s
), l as (
  select a.doc_id as a, b.doc_id as b from t a join t b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r as (
  select doc_id as a, doc_id as b from s
  union
  select r.a, l.b from r join l on r.b = l.a
)
select s.doc_id, len(any_value(g))::bigint as n_shingles, min(r.b) as component_id from s join r on s.doc_id = r.a group by s.doc_id
"""
