"""Toxicity by class-conditional Kneser-Ney models that share their backoff counts."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeglass.llm.shared import cut, mix, words

#: Characters of the longest n-gram; Kneser-Ney's discount.
ORDER, DISCOUNT = 5, 0.75
#: Words to a window.
WINDOW = 8


def _grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For words written between spaces: where each word's characters end, the word of each character, the hashes of the
    1 to ORDER characters that end at each, and how many of them count (none reaches over a word's leading space)."""
    chars = np.frombuffer((" " + b" ".join(found).decode("utf-8", "replace") + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    spaces = np.flatnonzero(chars == 32)
    word = np.searchsorted(spaces, np.arange(1, len(chars)), side="left") - 1
    most = np.minimum(np.arange(1, len(chars)) - spaces[word] + 1, ORDER)
    hashes, h = [], np.zeros(len(chars), np.uint64)
    for k in range(ORDER):
        back = np.zeros(len(chars), np.uint64)
        back[k:] = chars[: max(0, len(chars) - k)]
        with np.errstate(over="ignore"):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(k + 1))
        hashes.append(h)
    return spaces, word, hashes, most


class Table:
    """Counts by key: sorted 64-bit hashes, each with its row of counts, as many as the corpus has. A last row of zeros is for all other keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.concatenate([counts[order], np.zeros((1, counts.shape[1]), counts.dtype)])
        self.find()

    def find(self) -> None:
        """Where the keys of each first bits begin, so that a look-up compares few of them: about one key to a beginning."""
        self.bits = max(1, min(26, len(self.keys).bit_length()))
        self.begins = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of each key."""
        at, n = self.begins[(keys >> np.uint64(64 - self.bits)).astype(np.int64)], len(self.keys)
        left = np.flatnonzero(at < n)
        while len(left := left[self.keys[at[left]] < keys[left]]):
            at[left] += 1
            left = left[at[left] < n]
        at[at < n] = np.where(self.keys[at[at < n]] == keys[at < n], at[at < n], n)
        return self.counts[at]

    def __getstate__(self) -> tuple:
        return tuple((zlib.compress(v.tobytes(), 1), v.dtype.str, v.shape) for v in (self.keys, self.counts))

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.counts = (np.frombuffer(zlib.decompress(v), kind).reshape(shape) for v, kind, shape in state)
        self.find()


@dataclass
class Model:
    """Counts by key: of whole n-grams and their contexts for either class, and the continuation counts of shorter
    n-grams and their contexts, which both classes share. The tables grow with the distinct n-grams of the corpus."""

    top: Table
    context: Table
    low: Table
    low_context: Table
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.0

    def word_ratios(self, found: list[bytes], of: int | None = None) -> np.ndarray:
        """Log-likelihood of each word as a toxic one less that as an ordinary one.

        With `of`, the words are all those of one text that was counted in that class, and its own counts are left out.
        """
        spaces, word, hashes, most = _grams(found)
        total = max(self.low_context(np.zeros(1, np.uint64))[0, 0], 1.0)
        shared = 0.99 * self.low(hashes[0][1:])[:, 0] / total + 0.01 / 256
        p = shared
        for k in range(1, ORDER - 1):
            c = self.low_context(hashes[k - 1][:-1])
            seen = c[:, 0] > 0
            t = np.where(seen, c[:, 0], 1)
            q = np.maximum(self.low(hashes[k][1:])[:, 0] - DISCOUNT, 0) / t + np.clip(DISCOUNT * c[:, 1] / t, 1e-3, 1) * p
            p = np.where((most > k + 1) & seen, q, p)
        row = np.arange(len(most))
        at = np.stack(hashes)[most - 1, row + 1]
        before = np.stack(hashes)[most - 2, row]
        n, c = self.top(at).astype(np.float64), self.context(before).astype(np.float64)
        if of is not None:
            own = lambda x: (lambda u: u[2][u[1]])(np.unique(x, return_inverse=True, return_counts=True))
            n[:, of] = np.maximum(n[:, of] - own(at), 0)
            c[:, of] = np.maximum(c[:, of] - own(before), 0)
            c[:, 2 + of] = np.minimum(c[:, 2 + of], c[:, of])
        logs = []
        for y in (0, 1):
            seen = c[:, y] > 0
            t = np.where(seen, c[:, y], 1)
            logs.append(np.log(np.where(seen, np.maximum(n[:, y] - DISCOUNT, 0) / t + np.clip(DISCOUNT * c[:, 2 + y] / t, 1e-3, 1) * p, p)))
        return np.add.reduceat(logs[1] - logs[0], spaces[:-1])

    def probability(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.prior)
        z = np.c_[np.ones(len(rows)), (rows - self.centre) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(ratios: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Length-normalised ratios of a text, of its windows and of its words; all zero for a text without words."""
    n = len(ratios)
    if not n:
        return [0.0] * 10
    m = min(WINDOW, n)
    sums, chars = np.cumsum(np.concatenate([[0.0], ratios])), np.cumsum(np.concatenate([[0.0], sizes]))
    best = -np.sort(-ratios)[: 8]
    high = int((ratios > 3).sum())
    return [sums[-1] / chars[-1], ((sums[m:] - sums[:-m]) / (chars[m:] - chars[:-m])).max(), *(best[min(k, n - 1)] for k in (0, 1, 2, 3, 6)), np.log1p(high), high / n, np.log1p(n)]


_HELD: dict[str, tuple[Model, dict[bytes, float]]] = {}


def _held(name: str, shared) -> tuple[Model, dict[bytes, float]]:
    """The broadcast model and the words seen with it, kept in a Python worker."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = (shared.value, {})
    return _HELD[name]


def score_batch(model: Model, memo: dict[bytes, float], texts: list[str | None]) -> np.ndarray:
    """Features of each text; `memo` keeps the ratios of words."""
    split = [words(t) for t in texts]
    if len(memo) > 800_000:
        memo.clear()
    new = list(set().union(*split).difference(memo))
    for a in range(0, len(new), 50_000):
        part = new[a : a + 50_000]
        memo.update(zip(part, model.word_ratios(part).tolist(), strict=True))
    out = np.zeros((len(texts), 10))
    for i, w in enumerate(split):
        out[i] = features(np.fromiter(map(memo.__getitem__, w), np.float64, len(w)), np.fromiter(map(len, w), np.float64, len(w)) + 1)
    return out


def in_training(doc_id: str = "doc_id"):
    """Whether labels of a document may be learnt from: its number's crc32 modulo 3 is not 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        found = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(pa.array([c[w] for w in found], pa.int64()) for c in held)], names=["word", "n0", "n1"])
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            held[toxic].update(words(text))
        if sum(map(len, held)) > 400_000:
            yield rows()
    yield rows()


_GRAM_ROWS = "kind int, a bigint, b bigint, c bigint, n0 bigint, n1 bigint"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of counted words: kind 0, n-grams (a) with their contexts (b) and class counts; kind 1, each shorter n-gram with a
    character before it (a), itself (b), and its context (c; 0 if it is a single character)."""
    for batch in batches:
        found, counts = batch["word"].to_pylist(), np.stack([batch["n0"].to_numpy(), batch["n1"].to_numpy()], 1)
        for low in range(0, len(found), 20_000):
            _, word, hashes, most = _grams(found[low : low + 20_000])
            row = np.arange(len(most))
            every = np.stack(hashes)
            top, context, n = every[most - 1, row + 1], every[most - 2, row], counts[low : low + 20_000][word]
            _, first, group = np.unique(top, return_index=True, return_inverse=True)
            sums = [np.bincount(group, n[:, y], len(first)).astype(np.int64) for y in (0, 1)]
            yield _gram_rows(0, top[first], context[first], np.zeros(len(first), np.uint64), *sums)
            for k in range(1, ORDER):
                at = np.flatnonzero(most > k)
                wide, inner = every[k, at + 1], every[k - 1, at + 1]
                outer = every[k - 2, at] if k > 1 else np.zeros(len(at), np.uint64)
                _, first = np.unique(wide, return_index=True)
                yield _gram_rows(1, wide[first], inner[first], outer[first], *[np.zeros(len(first), np.int64)] * 2)


def _gram_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.view(np.int64)) for c in columns)], names=["kind", "a", "b", "c", "n0", "n1"])


def _table(rows: DataFrame, key: str, *sums: str) -> Table:
    """Sums by key."""
    got = rows.groupBy(F.col(key).alias("key")).agg(*(F.sum(s).cast("double").alias(s) for s in sums)).toArrow()
    return Table(got["key"].to_numpy().view(np.uint64), np.stack([got[s].to_numpy() for s in sums], 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    b = np.zeros(x.shape[1] + 1)
    z = np.c_[np.ones(len(x)), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
    return b


def _likely(docs: DataFrame, known: DataFrame, bits: int = 24) -> DataFrame:
    """Documents without most of those that `known` lacks, so that few texts are shuffled in vain: its doc_ids set bits of a map
    of fixed size (2 ** (bits - 6) numbers of 64 bits at most, so it is broadcast), and documents whose bit is not set go."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    slot, bit = F.shiftright(at, 6).cast("int").alias("_slot"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {1 << bits}L) % 64))").alias("_bit")
    filled = known.select(slot, bit).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    return docs.withColumns({"_slot": slot, "_bit": bit}).join(F.broadcast(filled), "_slot").filter("_bits & _bit <> 0").drop("_slot", "_bit", "_bits")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fits the two models on all labelled documents that may be learnt from, and their calibration on a bounded sample.

    Words of all these documents are counted by class; character n-grams of the counted words, up to ORDER and within
    words, give either class its own counts of the longest ones, discounted, and both one set of continuation counts
    (Kneser-Ney: in how many contexts an n-gram occurs) to fall back on for rare ones. All counts are Spark
    aggregations over all of the corpus; the driver and each worker hold one row of them per distinct n-gram and context.

    The calibration is a logistic regression over `features` of the `sample` labelled documents of smallest hash, whose
    own counts are left out, one row of each doc_id. Labels other than 0 and 1 are ignored; of several for a document the highest holds. Without
    both classes every score is the share of toxic labels.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & in_training()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pool = docs.filter(in_training()).select("doc_id", "text")
    counted = cut(_likely(pool, known).join(known.hint("merge"), "doc_id").select("text", "toxic").mapInArrow(_count_words, "word binary, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    grams = counted.mapInArrow(_count_grams, _GRAM_ROWS)
    grams = cut(grams.groupBy("kind", "a", "b", "c").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    top, low = grams.filter("kind = 0"), grams.filter("kind = 1").groupBy("b", "c").agg(F.count("*").alias("n"))
    model = Model(*[None] * 4)
    model.top = _table(top, "a", "n0", "n1")
    model.context = _table(top.selectExpr("b", "n0", "n1", "int(n0 > 0) as y0", "int(n1 > 0) as y1"), "b", "n0", "n1", "y0", "y1")
    model.low = _table(low, "b", "n")
    model.low_context = _table(low.selectExpr("c", "n", "1 as y"), "c", "n", "y")

    top_hash = F.xxhash64("doc_id")
    chosen = known.orderBy(top_hash, "doc_id").limit(sample)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = _held(name, shared)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                w = words(text)
                rows.append([float(toxic), *features(m.word_ratios(w, toxic) if w else np.zeros(0), np.array([len(x) + 1 for x in w], float))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "row"])

    got = pool.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(rate, "doc_id bigint, row array<double>").groupBy("doc_id").agg(F.min("row").alias("row")).toArrow()
    shared.destroy()
    rows = np.array(got["row"].to_pylist(), float).reshape(-1, 11)
    rows = rows[np.lexsort(rows.T)]
    y, x = rows[:, 0], rows[:, 1:]
    model.prior = float(y.mean()) if len(y) else 0.0
    if 0 < y.sum() < len(y):
        model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
        model.weights = _logistic((x - model.centre) / model.scale, y)
    return model


def with_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxicity", **options) -> DataFrame:
    """The documents with a score from 0 to 1, higher where the label 1 is likelier, from their whole texts alone.

    Null, empty and wordless texts all have the score of a text without evidence. Long texts are read whole, in time in
    proportion to their words. Rows repeated under a doc_id are scored alike, and count as often as they occur where they are
    learnt from; a null doc_id is scored but has no label. An empty table stays empty, and without labels of both classes every score
    is the share of toxic ones. A column of that name is replaced, and all others stay.
    """
    model = train(docs, labels, **options)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, memo = _held(name, shared)
        for batch in batches:
            texts = batch.to_pylist()
            rows = [score_batch(m, memo, texts[a : a + 500]) for a in range(0, len(texts), 500)]
            yield pa.array(m.probability(np.concatenate(rows) if rows else np.zeros((0, 10))))

    return docs.withColumn(column, score("text"))
