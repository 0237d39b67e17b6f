"""Token counts by a linear longest-match automaton: greedy word pieces are counted without building any.

The vocabulary's strings form a trie. At a node, failing means: pop the longest piece that the string read so far
starts with, and go on from what is left. Where that leads, and how many pieces are popped, is computed once for each
node from its parent's. A word is then read once, byte by byte; every byte moves down one edge, after failures that
each pop a piece. numpy reads all distinct words of a run side by side.

Words stand between white space (0x20, 0x09-0x0D) and are read with a space before them. Every single byte must be in
the vocabulary, so no word is unknown.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.flat import NOT_SPACE, flat, in_small_batches, runs, span_hashes, spans

#: Bytes read at once.
RUN = 1 << 21
#: When fewer words than this are still being read, each is read to its end by itself.
FEW = 200


class Automaton:
    """Trie edges as sorted keys (node * 256 + byte) with their ends; fail and popped for each node."""

    def __init__(self, vocabulary: Iterable[bytes]):
        edges: dict[int, int] = {}
        final, parents, last = [False], [0], [0]
        for piece in vocabulary:
            n = 0
            for byte in piece:
                key = n << 8 | byte
                m = edges.get(key)
                if m is None:
                    m = edges[key] = len(final)
                    final.append(False), parents.append(n), last.append(byte)
                n = m
            final[n] = n > 0
        if any(b not in edges or not final[edges[b]] for b in range(256)):
            raise ValueError("every single byte must be a piece of the vocabulary")
        fail, popped = [0] * len(final), [0] * len(final)
        level = [0]
        below: dict[int, list[int]] = {}
        for m in range(1, len(final)):
            below.setdefault(parents[m], []).append(m)
        while level:
            level = [m for n in level for m in below.get(n, ())]
            for m in level:
                if final[m]:
                    popped[m] = 1
                    continue
                n, byte = parents[m], last[m]
                at, count = fail[n], popped[n]
                while at << 8 | byte not in edges:
                    count += popped[at]
                    at = fail[at]
                fail[m], popped[m] = edges[at << 8 | byte], count
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.ends = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.popped = np.array(fail), np.array(popped)
        self.space = edges[0x20]
        self._plain = edges, fail, popped

    def _read(self, at: int, rest: bytes) -> tuple[int, int]:
        """State after ``rest`` from state ``at``, and pieces popped on the way."""
        edges, fail, popped = self._plain
        count = 0
        for byte in rest:
            key = at << 8 | byte
            while key not in edges:
                count += popped[at]
                at = fail[at]
                key = at << 8 | byte
            at = edges[key]
        return at, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of pieces of a space and each stretch."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so those still read are a head
        starts, length = starts[order], (ends - starts)[order]
        at, count = np.full(len(starts), self.space), np.zeros(len(starts), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))
            if n < FEW:
                for i in range(n):
                    at[i], more = self._read(int(at[i]), data[starts[i] + t : starts[i] + length[i]].tobytes())
                    count[i] += more
                break
            byte, todo = data[starts[:n] + t].astype(np.int64), np.arange(n)
            while len(todo):
                key = at[todo] << 8 | byte[todo]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                at[todo[hit]] = self.ends[k[hit]]
                todo = todo[~hit]
                count[todo] += self.popped[at[todo]]
                at[todo] = self.fail[at[todo]]
        while (at > 0).any():
            count += np.where(at > 0, self.popped[at], 0)
            at = np.where(at > 0, self.fail[at], 0)
        out = np.empty_like(count)
        out[order] = count
        return out


def vocabulary_of(path: str) -> list[bytes]:
    """Pieces of a file of ranks: a base64 string and a number on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text of ``docs`` (doc_id, text); other columns are not read.

    ``path``: a vocabulary file that executors can open; the automaton is built from it once in each task. Null and
    empty texts have 0 of either. Rows stay one to one, repeated rows and null ids too.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(vocabulary_of(path))
        for batch in batches:
            data, offsets = flat(batch.column(1))
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, part, off in runs(data, offsets, RUN):
                starts, ends, doc = spans(NOT_SPACE[part], off)
                _, first, which = np.unique(span_hashes(part, starts, ends, lower=False), return_index=True, return_inverse=True)
                each = automaton.counts(part, starts[first], ends[first])[which]
                n_words[i:j] = np.bincount(doc, minlength=j - i)
                n_tokens[i:j] = np.bincount(doc, each, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("byte_bpe_50k.tiktoken"))
