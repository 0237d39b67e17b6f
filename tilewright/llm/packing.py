"""Best-two-fit packing of token documents into sequences of fixed length.

Tokenizing works on stretches that start at a space before a visible character: byte-level pre-tokenizers always split
there, so a stretch has the same ids wherever it stands. Added tokens of the vocabulary are stretches of their own with
their one id, and end the text before them. Each distinct stretch of a batch is encoded once.

Packing works on lengths alone. Pieces are dealt evenly to shards of about ``SHARD_ROWS``, and each shard is packed by
itself; a shard wastes about one sequence, so as few sequences are used as in one large packing, nearly.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.flat import flat, in_small_batches, runs, span_hashes
from tilewright.session import stage

SHARD_ROWS = 20_000
#: Bytes tokenized at once, and distinct stretches a worker remembers. Both take memory in every worker of an executor.
RUN, REMEMBERED = 1 << 20, 1 << 18

#: Bytes that, after a space, are surely no white space: visible ASCII, and leads of characters none of which is.
_VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)])


class StretchTokenizer:
    """Token ids of texts by a byte-level BPE given as a file of ranks, and by added tokens, which have an id as a whole."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        self.added = {k.encode(): v for k, v in (added or {}).items()}
        # At one place the longest added token wins.
        self.find_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).finditer if self.added else None

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}  # hash to place in ids and, in the low bits, number of ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, key: int, text: bytes) -> int:
        got = [self.added[text]] if text in self.added else self.encode(text.decode())
        if self.used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(got)), np.uint32)])
        self.ids[self.used : self.used + len(got)] = got
        self.at[key] = out = self.used << 31 | len(got)
        self.used += len(got)
        return out

    def added_spans(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Starts and ends of added tokens, two columns; none goes over the end of a text."""
        spans = np.array([m.span() for m in self.find_added(raw)], np.int64).reshape(-1, 2)
        if (np.searchsorted(offsets, spans[:, 0], "right") != np.searchsorted(offsets, spans[:, 1] - 1, "right")).any():
            at = offsets.tolist()
            spans = np.array([(m.start() + a, m.end() + a) for a, b in zip(at, at[1:], strict=False) for m in self.find_added(raw[a:b])], np.int64).reshape(-1, 2)
        return spans

    def encode_run(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts of a run, each followed by the id ``end``."""
        if len(self.at) > REMEMBERED:
            self.clear()
        n = len(offsets) - 1
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[: len(data) - 1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        raw = data.tobytes()
        if self.find_added:
            spans = self.added_spans(raw, offsets)
            # White space before an added token ends a text: it is not parted.
            cut[spans[spans[:, 0] > 0, 0] - 1] = False
            cut[spans.ravel()] = True
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, which = np.unique(span_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        keys = keys.tolist()
        known = list(map(self.at.get, keys))
        for k in [k for k, x in enumerate(known) if x is None]:
            known[k] = self._learn(keys[k], raw[starts[first[k]] : ends[first[k]]])
        known = np.array(known, np.int64)[which]
        place, lengths = known >> 31, known & 0x7FFFFFFF
        doc = np.searchsorted(offsets, starts, "right") - 1
        per_doc = np.bincount(doc, lengths, n).astype(np.int64) + 1
        out_offsets = np.concatenate([[0], np.cumsum(per_doc)])
        target = np.cumsum(lengths) - lengths + doc  # one end id stands after each text before
        out = np.full(out_offsets[-1], end, np.uint32)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(target, lengths) + within] = self.ids[np.repeat(place, lengths) + within]
        return out, out_offsets


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end: int = 0, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` ids, the id ``end`` after each text.

    Only longer documents are cut, into pieces of ``capacity``; the first takes what is left over. A null or empty
    text is the end id alone. Strings of ``added`` have their id wherever they stand in a text. Returns doc_id, piece, start, length, ids_crc32 and, if asked for, ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = StretchTokenizer(path, pattern, added)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            doc_ids = batch.column(0).cast(pa.int64())
            for i, j, part, off in runs(data, offsets, RUN):
                ids, at = tokenizer.encode_run(part, off, end)
                ids = ids.astype("<u4", copy=False)
                rows = []
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    edges = [a, *range(a + ((b - a) % capacity or capacity), b, capacity), b] if b - a > capacity else [a, b]
                    rows += [(d, k, x - a, y - x, zlib.crc32(ids[x:y]), x, y) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
                where, k, start, length, crc, x, y = map(list, zip(*rows, strict=True)) if rows else [[]] * 7
                columns = [doc_ids.slice(i, j - i).take(pa.array(where, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[p:q].tolist() for p, q in zip(x, y, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers. Each bin starts with the longest row left and takes the longest that fits, again and again;
    then its smallest row makes way for two rows left that fill the widened gap more tightly, if there are any."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    left = sorted(stacks)

    def take(n: int) -> int:
        i = stacks[n].pop()
        if not stacks[n]:
            left.pop(bisect_right(left, n) - 1)
        return i

    def put(n: int, i: int) -> None:
        if not stacks.setdefault(n, []):
            insort(left, n)
        stacks[n].append(i)

    bins = []
    while left:
        n = left[-1]
        rows, gap = [(n, take(n))], capacity - n
        while gap and left and left[0] <= gap:
            n = left[bisect_right(left, gap) - 1]
            rows.append((n, take(n)))
            gap -= n
        if gap and len(left) and 2 * left[0] <= gap + rows[-1][0]:
            pair = best_pair(left, stacks, gap + rows[-1][0])
            if pair and sum(pair) > rows[-1][0]:
                n, i = rows.pop()
                rows += [(m, take(m)) for m in pair]
                put(n, i)
        bins.append([i for _, i in rows])
    return bins


def best_pair(left: list[int], stacks: dict[int, list[int]], gap: int) -> tuple[int, int] | None:
    """The two rows left whose lengths sum to the most that is at most ``gap``."""
    a = np.array(left[: bisect_right(left, gap)])
    at = np.searchsorted(a, gap - a, "right") - 1
    own = (at == np.arange(len(a))) & (np.array([len(stacks[n]) for n in a.tolist()]) < 2)
    at = at - own
    total = np.where(at >= 0, a + a[at], -1)
    k = int(total.argmax())
    return (int(a[k]), int(a[at[k]])) if total[k] > 0 else None


PACKED = PIECES + ", sequence_id long, offset long"


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence holds more than ``capacity`` ids, and its pieces leave no gap.

    ``cut`` is staged first: its rows are then dealt to shards evenly, whatever their keys are. Repeated rows are
    packed each; an empty table gives an empty result.
    """
    cut = stage(cut, "pieces")
    shards = max(1, -(-cut.count() // SHARD_ROWS))

    def pack_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        bins = best_two_fit(rows.column("length").to_numpy(), capacity)
        order = np.concatenate(bins).astype(np.int64)
        sizes = np.array([len(b) for b in bins])
        length = rows.column("length").to_numpy()[order]
        ends = np.cumsum(length)
        first = np.cumsum(sizes) - sizes
        offset = ends - length - np.repeat(ends[first] - length[first], sizes)
        sequence = np.repeat(np.arange(len(bins)), sizes) + (TaskContext.get().partitionId() << 32)
        out = rows.take(pa.array(order)).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    return cut.repartition(shards).mapInArrow(pack_shard, PACKED)


#: Of the registered query: ids of a sequence.
CAPACITY = 2048


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file of ``tokenizers``, as texts with their ids; only ones without conditions."""
    with open(path) as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("an added token asks for what stands around it")
    return {t["content"]: t["id"] for t in tokens}


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` (doc_id, text) cut into pieces and packed, with the public byte-level vocabulary of 50k."""
    import public_tokenizers as public

    added = added_tokens(public.path("byte_bpe_50k.json"))
    return pack(pieces(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, capacity, added=added), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, packed into sequences.

    A row gives pieces of its own, also if repeated; null and empty texts are the end id alone. An empty table gives none.
    """
    return pack_documents(docs)
