"""Evaluation texts in training documents (problem 7).

Test questions and answers are folded to words and laid into one Aho-Corasick automaton in pieces
that follow one another: with ``min_words`` = 12, six of every seven words. Any twelve words in a row
of an item hold one whole piece, so the automaton is as large as the items' text and not twelve
times that. Each document is folded and scanned once, where it is read: no shuffle, no candidate
pairs. A piece that is met is widened to both sides, word by word, against its item; what reaches
``min_words`` words is a quotation. Quotations of an item that touch are joined and mapped to offsets
in the original text, whatever folding did to its length.

Items come in shards of at most ``SHARD_CHARACTERS`` (or one longer item). Each shard has its own
automaton and its own pass over the documents, so any amount of evaluation text is searched in bounded
memory. A Python worker builds the automaton of a shard once and keeps it for its later tasks.

Words are folded (case, marks and d-stroke) runs of letters, digits and ``_``; characters that are
not drawn are left out first, so a soft hyphen does not cut a word.

Defined results: null, empty or wordless texts and items of fewer than ``min_words`` words have no
hit. An item listed twice is reported under each of its ids; copies of a document give copies of
its rows. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cinequery.functions.characters import MARKS, UNDRAWN

#: Characters of evaluation text in one automaton; more make more automata and passes.
SHARD_CHARACTERS = 2_000_000
#: Folded chunks of text that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 40

_WORD, _CHUNK = re.compile(r"\w+"), re.compile(r"\S+")
_MARKS, _UNDRAWN = re.compile(f"[{MARKS}]+"), re.compile(f"[{UNDRAWN}]+")


def fold(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFD", _UNDRAWN.sub("", text).casefold().replace("đ", "d")))


class _Folder(dict):
    """Words of a chunk without white space, by one space apart. Chunks come again and again."""

    def __missing__(self, chunk: str) -> str:
        folded = " ".join(_WORD.findall(fold(chunk)))
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = folded
        return folded

    def line(self, text: str) -> str:
        """The words of a text, one space between, before and after; folding never looks across white space."""
        return f" {' '.join(filter(None, map(self.__getitem__, text.split())))} "


class _Lengths(dict):
    """How many characters a character folds to."""

    def __missing__(self, c: str) -> int:
        self[c] = n = len(fold(c))
        return n


_LENGTHS = _Lengths()


def _places(text: str, folder: _Folder, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """(start, end) in ``text`` of the words with the ``wanted`` numbers; only chunks that hold one are looked into."""
    out: dict[int, tuple[int, int]] = {}
    number, order, at = 0, sorted(wanted), 0
    for chunk in _CHUNK.finditer(text):
        raw = chunk.group()
        words = folder[raw]
        here = words.count(" ") + 1 if words else 0
        if at < len(order) and order[at] < number + here:
            origin = [chunk.start() + i for i, c in enumerate(raw) for _ in range(_LENGTHS[c])]
            found = list(_WORD.finditer(fold(raw)))
            while at < len(order) and order[at] < number + here:
                m = found[order[at] - number]
                out[order[at]] = (origin[m.start()], origin[m.end() - 1] + 1)
                at += 1
        if at == len(order):
            break
        number += here
    return out


class Search:
    """The automaton of a shard of items, and the search of texts in it."""

    def __init__(self, items: list[tuple[object, str]], min_words: int):
        import ahocorasick

        self.folder, self.least = _Folder(), min_words
        self.items = [self.folder.line(text).split() for _, text in items]
        size = (min_words + 1) // 2
        step = min_words - size + 1
        pieces: dict[str, list[tuple[int, int]]] = {}
        for place, words in enumerate(self.items):
            if len(words) >= min_words:
                for j in range(0, len(words) - size + 1, step):
                    pieces.setdefault(f" {' '.join(words[j : j + size])} ", []).append((place, j + size - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, tuple(places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _widened(self, words: list[str], k: int, item: list[str], j: int) -> tuple[int, int]:
        """First and last word of the longest stretch around word ``k`` that agrees with the item around ``j``."""
        first, last = k, k
        while first and j - (k - first) and words[first - 1] == item[j - (k - first) - 1]:
            first -= 1
        rest = min(len(words) - 1, k + len(item) - 1 - j)
        while last < rest and words[last + 1] == item[j + last + 1 - k]:
            last += 1
        return first, last

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item place, start, end) of each maximal quotation, with offsets in code points of ``text``."""
        if not text or self.empty:
            return []
        line = self.folder.line(text)
        words: list[str] | None = None
        counted = k = 0
        reached: dict[tuple[int, int], int] = {}  # how far each alignment of text and item was followed
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, places in self.automaton.iter(line):
            if words is None:
                words = line.split()
            k += line.count(" ", counted, end)
            counted = end
            for place, j in places:
                way = (place, k - 1 - j)
                if reached.get(way, -1) < k - 1:
                    first, last = self._widened(words, k - 1, self.items[place], j)
                    reached[way] = last
                    if last - first + 1 >= self.least:
                        spans.setdefault(place, []).append((first, last))
        if not spans:
            return []
        out = []
        for place, parts in spans.items():
            joined: list[list[int]] = []
            for first, last in sorted(parts):
                if joined and first <= joined[-1][1] + 1:
                    joined[-1][1] = max(joined[-1][1], last)
                else:
                    joined.append([first, last])
            out += [(place, a, b) for a, b in joined]
        where = _places(text, self.folder, {w for _, *ends in out for w in ends})
        return [(place, where[a][0], where[b][1]) for place, a, b in out]


#: The search of the shard that this worker saw last.
_KEPT: dict[tuple[str, int], Search] = {}


def _kept(mark: str, items: list[tuple[object, str]], min_words: int) -> Search:
    if (mark, min_words) not in _KEPT:
        _KEPT.clear()
        _KEPT[(mark, min_words)] = Search(items, min_words)
    return _KEPT[(mark, min_words)]


def _shards(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for key, text in items.toLocalIterator():
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield held


def find_leaks(documents: DataFrame, items: DataFrame, document_key: str, text: str, item_key: str, item_text: str, min_words: int = 12, shard_characters: int = SHARD_CHARACTERS) -> DataFrame:
    """(document key, item key, start_char, end_char): every quotation of at least ``min_words`` words of an item."""
    if min_words < 1 or shard_characters < 1:
        raise ValueError("min_words and shard_characters must be at least 1")
    spark = documents.sparkSession
    kinds = [documents.schema[document_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    names = [document_key, item_key, "start_char", "end_char"]
    schema = f"`{document_key}` {kinds[0]}, `{item_key}` {kinds[1]}, start_char long, end_char long"
    texts = documents.select(document_key, text)
    found: DataFrame | None = None
    for shard in _shards(items.select(item_key, item_text).dropna().distinct(), shard_characters):
        one = texts.mapInArrow(_searcher(spark.sparkContext.broadcast(shard), min_words, names, pa.array([shard[0][0]]).type), schema)
        found = one if found is None else found.unionAll(one)
    return spark.createDataFrame([], schema) if found is None else found


def _searcher(sent, min_words: int, names: list[str], key_kind: pa.DataType):
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _kept(mark, sent.value, min_words)
        for batch in batches:
            rows = [(i, *hit) for i, t in enumerate(batch.column(1).to_pylist()) for hit in search.scan(t)]
            if rows:
                i, p, a, b = zip(*rows)
                ids = batch.column(0).take(pa.array(i, pa.int64()))
                yield pa.record_batch([ids, pa.array([sent.value[x][0] for x in p], key_kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    return run
