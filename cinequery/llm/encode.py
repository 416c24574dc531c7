"""Encoding of a corpus with a byte-level BPE rank file (problem 6).

A text is cut by the tokenizer's pattern into words; a word that is no token itself is merged over a
contiguous array of part boundaries and the ranks of adjacent pairs: the smallest rank is found by
a scan, its boundary deleted and the ranks of the two neighbouring pairs refreshed. Scans make this
quadratic, so a word of more than ``SHORT_WORD`` bytes (a text without spaces, an endless line)
takes a heap over a linked list instead, with the same result. Both choose the leftmost of equal
ranks, as the merge rule demands.

Defined results: null and empty texts give an empty list; every document gives one row, copies
included; the text is taken as it is (no normalisation; special tokens' strings are plain text).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT_WORD = 256
#: Encoded words that a task remembers. The least it costs is speed.
CACHED_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line: the tokenizer's own table, of one size whatever the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    none = len(ranks) + 1 << 32
    get = ranks.get
    bounds = list(range(len(word) + 1))
    near = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in n log n steps."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # Stale: the left part is gone or grew, or the right one did.
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts with one rank table; keeps the words it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else (merge_short if len(raw) <= SHORT_WORD else merge_long)(raw, self.ranks)
        if len(raw) <= SHORT_WORD:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def text(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known.get, []
        for w in self.words(text):
            out += known(w) or self.word(w)
        return out


def encode_corpus(documents: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """(key, ids ARRAY<INT>) for each document. No shuffle: documents are encoded where they are read."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            encoded = [encoder.text(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(encoded, pa.list_(pa.int32()))], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
