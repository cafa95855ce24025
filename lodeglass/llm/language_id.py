"""The language of whole texts by hyperdimensional profiles of their letters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def in_training(doc_id: str = "doc_id") -> Column:
    """Whether a document may be learnt from; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) != 2


class Profiles(dict):
    """Bundles of texts: word -> numbers of the n-grams of the word between two spaces, remembered.

    A letter has a random vector of `dim` signs that only its code point decides. An n-gram binds its letters' vectors by
    product, each permuted (rotated) by its distance from the n-gram's end, and a text bundles its n-grams by sum. Sums
    are of integers, so they don't depend on the order of rows. At most some `most` n-grams' vectors are kept at a time,
    and what is remembered goes once there are more; vectors beyond them are made in blocks and dropped.
    """

    def __init__(self, dim: int = 1024, n: int = 3, most: int = 60_000) -> None:
        super().__init__()
        self.dim, self.n, self.most = dim, n, most
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.letters, self.numbers, self.grams, self.made = {}, {}, [], 0
        self.vectors = np.zeros((1024, self.dim), np.int8)

    def letter(self, char: str) -> np.ndarray:
        if (found := self.letters.get(char)) is None:
            bits = np.random.Generator(np.random.Philox(key=ord(char))).integers(0, 2, self.dim)
            found = self.letters[char] = (2 * bits - 1).astype(np.int8)
        return found

    def gram(self, gram: str) -> np.ndarray:
        found = self.letter(gram[-1])
        for k in range(1, self.n):
            found = found * np.roll(self.letter(gram[-1 - k]), k)
        return found

    def _number(self, gram: str) -> int:
        if (k := self.numbers.get(gram)) is None:
            k = self.numbers[gram] = len(self.grams)
            self.grams.append(gram)
        return k

    def __missing__(self, word: str) -> bytes:
        found = []
        for part in [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split():
            padded = f" {part} "
            found += [self._number(padded[i : i + self.n]) for i in range(len(padded) - self.n + 1)]
        ids = np.array(found, np.int32).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _vectors_of(self, ids: np.ndarray, kind: type) -> np.ndarray:
        """The vectors of n-grams of ascending numbers; the first `most` are kept."""
        keep = min(len(self.grams), self.most)
        if keep > len(self.vectors):
            more = np.zeros((min(max(keep, 2 * len(self.vectors)), self.most), self.dim), np.int8)
            more[: self.made] = self.vectors[: self.made]
            self.vectors = more
        for k in range(self.made, keep):
            self.vectors[k] = self.gram(self.grams[k])
        self.made = max(self.made, keep)
        cut = int(np.searchsorted(ids, keep))
        rest = [self.gram(self.grams[k]) for k in ids[cut:]]
        return np.concatenate([self.vectors[ids[:cut]].astype(kind), np.array(rest, kind).reshape(-1, self.dim)])

    def bundles(self, texts: list[str | None], owners: list[int], n: int) -> np.ndarray:
        """n bundles, each of all n-grams of the texts whose owner it is."""
        if len(self.grams) > self.most or len(self) > 400_000:
            self._forget()
        found = [np.frombuffer(b"".join(map(self.__getitem__, _WORD.findall((t or "").lower()))), np.int32) for t in texts]
        ids = np.concatenate([*found, np.zeros(0, np.int32)])
        out = np.zeros((n, self.dim), np.int64)
        if not len(ids):
            return out
        used, at = np.unique(ids, return_inverse=True)
        at = at + np.repeat(np.array(owners, np.int64), [len(f) for f in found]) * len(used)
        kind = np.float32 if len(ids) < 1 << 23 else np.float64  # sums of so many signs are exact
        counts = np.bincount(at, minlength=n * len(used)).reshape(n, -1).astype(kind)
        for a in range(0, len(used), 8192):
            out += (counts[:, a : a + 8192] @ self._vectors_of(used[a : a + 8192], kind)).astype(np.int64)
        return out


def _portions(texts: list[str | None], chars: int = 200_000, rows: int = 64) -> Iterator[tuple[int, int]]:
    """Bounds of portions of so many rows and, but for single longer texts, characters."""
    a = size = 0
    for b, text in enumerate(texts):
        if b > a and (b - a == rows or size + len(text or "") > chars):
            yield a, b
            a, size = b, 0
        size += len(text or "")
    if texts:
        yield a, len(texts)


def prototypes(docs: DataFrame, lang: str = "lang", dim: int = 1024, n: int = 3) -> DataFrame:
    """lang and the bundle of all n-grams of all its texts; rows without a text or language are left out.

    Each task bundles the languages that it meets and emits one vector for each (those so far, once it holds 4,096), so
    that what is shuffled grows with tasks and languages, not with documents, and a language of a third of all rows is
    summed in parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, held = Profiles(dim, n), {}
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for a, b in _portions(texts):
                own = {x: k for k, x in enumerate(dict.fromkeys(langs[a:b]))}
                for x, found in zip(own, profiles.bundles(texts[a:b], [own[x] for x in langs[a:b]], len(own)), strict=True):
                    held[x] = held[x] + found if x in held else found
            if len(held) >= 4096:
                yield _emitted(held)
                held = {}
        yield _emitted(held)

    found = docs.select("text", F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null").mapInArrow(run, "lang string, vector array<bigint>")
    summed = found.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return summed.groupBy("lang").agg(ordered.alias("vector"))


def _emitted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held, pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], names=["lang", "vector"])


def with_language(docs: DataFrame, learnt: DataFrame, column: str = "language", dim: int = 1024, n: int = 3) -> DataFrame:
    """The documents with a struct column of their likeliest language, among those of `learnt`, and a score from 0 to 1.

    `learnt` has a text and a lang; its languages' prototypes come to the driver and go to every worker (8 * dim bytes a
    language, so a thousand languages are 8 MB). A text's language is the one whose prototype has the greatest cosine with
    the text's bundle, of equal ones the first in code-point order, and the score is that cosine, no less than 0. N-grams
    run over letters in lower case with one space before and after a word.

    A text that is null, empty or without a letter is `und` with a score of 0, and so is every text where nothing was
    learnt. Long texts are read whole. Rows are scored where they stand, without a shuffle: repeated ones alike, and an
    empty table stays empty. A column of the given name is replaced, and all others stay.
    """
    rows = sorted((r.lang, r.vector) for r in prototypes(learnt, dim=dim, n=n).collect() if any(r.vector))
    names = [r[0] for r in rows]
    known = np.array([r[1] for r in rows], float).reshape(-1, dim)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((names, known))

    @arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiles, (names, known) = Profiles(dim, n), shared.value
        for batch in batches:
            texts, langs, scores = batch.to_pylist(), [], []
            for a, b in _portions(texts):
                bundles = profiles.bundles(texts[a:b], list(range(b - a)), b - a).astype(float)
                size = np.linalg.norm(bundles, axis=1, keepdims=True)
                near = np.round(bundles @ known.T / np.maximum(size, 1), 12)
                some = (size[:, 0] > 0) & bool(names)
                best = near.argmax(1) if names else np.zeros(b - a, int)
                langs += [names[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)]
                scores += [min(1.0, max(0.0, float(row[k]))) if s else 0.0 for row, k, s in zip(near, best, some, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_RESULT))

    return docs.withColumn(column, predict("text"))
