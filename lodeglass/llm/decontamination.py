"""Benchmark passages in documents, found by an Aho-Corasick automaton over windows of test items."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeglass.llm.shared import words

#: Words of an item that are sent as one row.
PIECE = 1000

FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:int,after:int>>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))])
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[str, object] = {}


class Passages:
    """One automaton for all windows of the given items' words: runs of `width` of them, or all words of a shorter item.

    A window of 2a - 1 words or more holds a whole block of a words that begins at a multiple of a in its item. So the
    automaton holds an item's blocks, apart from one another, and shorter items whole: about three nodes a word, a word being
    three letters of a small alphabet. Where a block occurs, the windows around it are looked up by a hash among all windows and
    compared word for word, so hits are exact. Some 200 bytes a word in all.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int) -> None:
        import ahocorasick
        import xxhash

        self.width, self.block, self.digest = width, (width + 1) // 2, xxhash.xxh3_64_intdigest
        vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number, flat, marks, keys, at, sizes, owners = {x: k for k, x in enumerate(self.names)}, array("I"), {}, array("Q"), array("Q"), array("H"), array("I")
        for item, found in items:
            begin, n = len(flat), min(width, len(found))
            flat.extend(vocabulary.setdefault(w, len(vocabulary)) for w in found)
            for i in range(len(found) - n + 1 if n else 0):
                keys.append(self.digest(b" ".join(found[i : i + n])))
                at.append(begin + i)
                sizes.append(n)
                owners.append(number[item])
            if 0 < n < width:
                marks[tuple(flat[begin:])] = marks.get(tuple(flat[begin:]), 0) | 2
            for i in range(0, len(found) - self.block + 1 if n == width else 0, self.block):
                part = tuple(flat[begin + i : begin + i + self.block])
                marks[part] = marks.get(part, 0) | 1
        self.words, self.flat = list(vocabulary), np.array(flat, np.uint32)
        self.letters = _Letters((w, _letter(k)) for w, k in vocabulary.items())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if marks else None
        for part, mark in marks.items():
            self.automaton.add_word("".join(map(_letter, part)), mark + 4 * len(part))
        if marks:
            self.automaton.make_automaton()
        keys, owners = np.array(keys, np.uint64), np.array(owners, np.uint32)
        order = np.lexsort((owners, keys))
        self.mixed: set[int] = set()  # where different windows of one hash begin
        self.keys, self.at, self.sizes, self.owners = keys[order], np.array(at, np.uint64)[order], np.array(sizes, np.uint16)[order], owners[order]
        for k in np.flatnonzero(self.keys[1:] == self.keys[:-1]):
            if not self._same(k, self._window(k + 1)):
                self.mixed.add(int(np.searchsorted(self.keys, self.keys[k])))

    def _window(self, k: int) -> list[bytes]:
        first = int(self.at[k])
        return [self.words[x] for x in self.flat[first : first + int(self.sizes[k])]]

    def _same(self, k: int, window: list[bytes]) -> bool:
        return self._window(k) == window

    def find(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which of the words lie inside a window's occurrence, and the items of these windows."""
        wanted: set[tuple[int, int]] = set()
        for end, mark in self.automaton.iter("".join(map(self.letters.__getitem__, found))) if self.automaton and found else ():
            last = end // 3
            first = last + 1 - (mark >> 2)
            if mark & 2:
                wanted.add((first, mark >> 2))
            if mark & 1:
                wanted.update((i, self.width) for i in range(max(0, last + 1 - self.width), min(first, len(found) - self.width) + 1))
        if not wanted:
            return np.zeros(len(found), bool), set()
        edge, items, windows = np.zeros(len(found) + 1, np.int64), set(), sorted(wanted)
        asked = np.array([self.digest(b" ".join(found[i : i + n])) for i, n in windows], np.uint64)
        for (i, n), low, high in zip(windows, np.searchsorted(self.keys, asked).tolist(), np.searchsorted(self.keys, asked, "right").tolist(), strict=True):
            mine = self.owners[low:high]
            if low in self.mixed:  # windows that differ and have one hash
                mine = mine[[self._same(k, found[i : i + n]) for k in range(low, high)]]
            if len(mine) and (low in self.mixed or self._same(low, found[i : i + n])):
                edge[i] += 1
                edge[i + n] -= 1
                items.update(mine.tolist())
        return np.cumsum(edge[:-1]) > 0, {self.names[k] for k in items}


class _Letters(dict):
    """Word -> letters; words of no item are all alike."""

    def __missing__(self, word: bytes) -> str:
        return "\0\0\0"


def _letter(k: int) -> str:
    """Three characters for a word's number, each of 128 of its own, so that matches begin and end with words and no node
    has more children. From 2,097,152 words on they are used again, which costs some look-ups and no hit."""
    return chr(1 + (k & 127)) + chr(129 + (k >> 7 & 127)) + chr(257 + (k >> 14 & 127))


def scan(text: str | None, passages: Passages) -> dict:
    """What is found in one text, scanned once: hit words, items and, in code points of the text itself, the hit spans."""
    w = words(text)
    hit, items = passages.find(w)
    return {"n_words": len(w), "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(text, hit) if hit.any() else []}


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """The runs of hit words (a flag for each word) in code points of the text."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    where = [m.span() for m in _ORIGINAL.finditer(text)]
    return [{"first": where[i][0], "after": where[j - 1][1]} for i, j in zip(turns[::2], turns[1::2], strict=True)]


def _built(name: str, shared, width: int) -> Passages:
    """The automaton of a broadcast list of pieces, built once in a Python worker, which keeps it for later tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Passages([(item, found.split()) for item, found in shared.value], width)
    return _BUILT[name]


def _pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """item, n, found: the items' words, of long ones in pieces that overlap by width - 1 words, so that each window lies in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                w = words(text)
                for a in range(0, max(1, len(w) - width + 1) if w else 0, PIECE):
                    part = w[a : a + PIECE + width - 1]
                    out.append({"item": item, "n": len(part), "found": b" ".join(part)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("n", pa.int64()), ("found", pa.binary())]))

    return benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, n bigint, found binary")


def with_passages(docs: DataFrame, benchmark: DataFrame, column: str = "passages", width: int = 10) -> DataFrame:
    """The documents with a struct column of what they share with a benchmark: words, hit words, items, hit spans.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased. A word is hit inside any
    occurrence of `width` consecutive words of an item, or of all words of a shorter item. Documents are read in place and
    scanned once by one automaton, whatever the benchmark's size; no text is shuffled or held in between.

    The benchmark's words go to every worker, which builds the automaton once and keeps it: some 200 bytes a word, so that
    a benchmark of two million words takes 0.4 GB of each worker. This grows with the benchmark, never with the documents.

    Null texts have no words; equal items count by their distinct ids, null ids and texts of the benchmark not at all;
    an empty benchmark hits nothing and an empty table stays empty. A column of the given name is replaced; all other
    columns and all rows, repeated ones too, stay.
    """
    items = [(r["item"], bytes(r["found"])) for r in _pieces(benchmark, width).select("item", "found").collect()]
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    @arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        passages = _built(name, shared, width)
        for batch in batches:
            yield pa.array([scan(t, passages) for t in batch.to_pylist()], _FOUND)

    return docs.withColumn(column, found("text"))
