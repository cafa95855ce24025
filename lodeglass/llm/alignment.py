"""Which tokens of two vocabularies stand for the same stretches of a text."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeglass.llm.shared import BYTE_CHARS, shared_folder, spare

_SECOND = 1 << 20  #: is added to ids of the second vocabulary where both stand in one array
_FAILED = (1 << 32) - 1
_CUT = re.compile(r"(?<=\S)(?= )")
_BLURRED = re.compile(r"\s ")
_RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def token_groups(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of the last tokens of each group on either side, in order.

    Two ascending arrays of byte ends that begin at 0 and end at the same place are cut at their common values by
    diagonal runs: an irregular group is resolved by stepping on the side that lags until both end together, which sets the
    shift between the indexes. From there on, stretches of 1, 2, 4, ... ends at that shift are compared at once, so that
    one-to-one tokens are jumped over; a stretch that differs is halved down to where it begins to. Only runs are noted,
    by where they begin, their length and their shift.
    """
    begins, lengths, shifts, i, j, n = [], [], [], 0, 0, len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        begin, i, j, step = i, i + 1, j + 1, 1
        while i < n and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        while step > 1 and i < n:
            step //= 2
            if ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
        begins.append(begin)
        lengths.append(min(i, n) - begin)
        shifts.append(j - i)
    lengths = np.array(lengths, np.int64)
    last_a = np.arange(lengths.sum()) + np.repeat(np.array(begins, np.int64) - lengths.cumsum() + lengths, lengths)
    return last_a, last_a + np.repeat(np.array(shifts, np.int64), lengths)


class PairEncoder(dict):
    """Ids of both vocabularies for a space and a text; piece -> its ids, those of the second with _SECOND added.

    Neither vocabulary has a token that goes on over a space behind something else, and the splitter of the first begins
    anew there, unless white space stands before the space; so a text's ids are those of its pieces between such spaces,
    one after another. Pieces of up to 64 characters are remembered, `most` twice, and what is new in a portion of texts
    is encoded together. A text with white space before a space is cut with care, and one with a piece that doesn't come
    back to its own bytes is encoded as a whole.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 300_000) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in BYTE_CHARS.items()}
        tokens = ((self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size()))
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces) or any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in self.bytes_a)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.most, self.old = most, {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Of texts without their first space."""
        first = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        second = self.b.encode(pieces, num_threads=1)
        flat = array("I", chain.from_iterable(first)), array("I", chain.from_iterable(second))
        want = [len(p.encode("utf-8", "replace")) + 1 for p in pieces]
        edges_a, edges_b, edges = ([0, *accumulate(x)] for x in (map(len, first), map(len, second), want))
        ids_a, ids_b = flat[0].tobytes(), (np.frombuffer(flat[1], np.uint32) + np.uint32(_SECOND)).tobytes()
        out = [ids_a[4 * i : 4 * j] + ids_b[4 * k : 4 * m] for i, j, k, m in zip(edges_a, edges_a[1:], edges_b, edges_b[1:])]
        whole = "".join(f" {p}" for p in pieces).encode("utf-8", "replace")
        sides = [(flat[1], edges_b, self.bytes_b, self.sizes_b)]
        if self.a.normalizer is not None:  # else the bytes come back as they are
            sides.append((flat[0], edges_a, self.bytes_a, self.sizes_a))
        for ids, at, tokens, sizes in sides:
            back = b"".join(map(tokens.__getitem__, ids))
            ends = np.append(0, sizes[np.frombuffer(ids, np.uint32)].cumsum())[at]
            if back != whole or (ends != np.array(edges)).any():
                for k in range(len(pieces)):
                    if back[ends[k] : ends[k + 1]] != whole[edges[k] : edges[k + 1]]:
                        out[k] = array("I", [_FAILED]).tobytes()
        return out

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            (ids,) = self._encoded([piece])
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _pieces(self, text: str) -> list[str]:
        """A space and the text, cut, each piece without its first space."""
        if self.whole:
            return [text]
        return text.split(" ") if not _BLURRED.search(f" {text}") else [p[1:] for p in _CUT.split(f" {text}")]

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of either vocabulary for each text; None where a text is empty or either's bytes differ from a space and the text."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        cut = [self._pieces(t) for t in texts]
        new = [p for p in set().union(*cut) if len(p) <= 64 and p not in self and p not in self.old]
        self.update(zip(new, self._encoded(new), strict=True))
        for text, pieces in zip(texts, cut, strict=True):
            ids = np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4") if text else np.zeros(0, "<u4")
            if len(pieces) > 1 and (ids == _FAILED).any():
                ids = np.frombuffer(self._encoded([text])[0], "<u4")
            second = ids >= _SECOND
            yield (ids[~second].astype(np.int64), ids[second].astype(np.int64) - _SECOND) if len(ids) and not (ids == _FAILED).any() else None


class _Written:
    """Renders groups as a1,a2|b1;a3|b2,b3."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.at = size_a
        self.parts = [f"{i}{sep}" for size, seps in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for sep in seps]

    def __call__(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        shown_a, shown_b = 2 * a, 2 * (self.at + b)
        shown_a[last_a] += 1
        shown_b[last_b] += 1
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(last_b - n_b + 1, n_a)] = shown_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = shown_b
        return "".join(map(self.parts.__getitem__, out.tolist()))[:-1].encode()


@lru_cache(maxsize=1)
def _held(path_a: str, path_b: str) -> tuple[PairEncoder, _Written]:
    """What a worker process keeps from task to task."""
    encode = PairEncoder(path_a, path_b)
    return encode, _Written(len(encode.bytes_a), len(encode.bytes_b))


def _aligner(path_a: str, path_b: str):
    """Groups and links of texts, and how often each linked pair of ids (a << 20 | b) occurs in them.

    Every two token occurrences whose byte ranges end together are a link; as no token is empty, that is one link for
    each group, between its last tokens.
    """
    fields = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]

    @arrow_udf(_RESULT)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, written = _held(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            for low, high in portions(texts):
                columns = zip(*(_row(encode, written, ids) for ids in encode(texts[low:high])), strict=True)
                yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return align


def portions(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of portions of so many characters and, where a text is longer, one text."""
    a = size = 0
    for b, text in enumerate(texts):
        if b > a and size + len(text) > chars:
            yield a, b
            a, size = b, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def _row(encode: PairEncoder, written: _Written, ids) -> tuple:
    if ids is None:
        return 0, 0, 0, 0, "", [], []
    a, b = ids
    last_a, last_b = token_groups(encode.sizes_a[a].cumsum().tolist(), encode.sizes_b[b].cumsum().tolist())
    pairs, times = np.unique(a[last_a] << 20 | b[last_b], return_counts=True)
    digest = hashlib.sha256(written(a, b, last_a, last_b)).hexdigest()
    return len(a), len(b), len(last_a), len(last_a), digest, pairs, times.astype(np.int32)


def pair_counts(groups: DataFrame) -> DataFrame:
    """pair, n (its links in all rows) and top (whether no pair of its second id has more), from the columns pairs and times."""
    counted = groups.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    second = F.col("pair").bitwiseAND(_SECOND - 1)
    best = counted.groupBy(second.alias("b")).agg(F.max("n").alias("best"))
    return counted.withColumn("b", second).join(best, "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))


def with_alignment(docs: DataFrame, path_a: str, path_b: str, column: str = "alignment") -> DataFrame:
    """The documents, but for their texts, with a struct of how their tokens in two vocabularies fall together.

    A space and the text is encoded by a byte-level vocabulary (a file of the tokenizers library) and the text by a
    sentencepiece model, which adds the space; special tokens' strings are plain text. The struct has n_a and n_b (tokens),
    n_groups (stretches between places where tokens of both end), n_links (pairs of token occurrences that end together),
    groups_sha256 (digest of `a1,a2|b1;a3|b2,b3`), n_best (links whose pair of ids is, in all rows, the most frequent of
    its second id, ties included) and count_sum (the links' pairs' counts in all rows, summed).

    Texts are encoded once; what a document keeps of that (its distinct pairs of ids and their numbers, no texts) is
    written to the shared folder, counted over all rows by a grouped sum, and read again with the counts at hand. Linked
    tokens end with the same bytes, so one is a suffix of the other: there are at most as many pairs as the vocabularies'
    tokens have suffixes, some 500,000 for vocabularies of 50,000 and 32,000, whatever the corpus. So the table of counts
    is sent to every worker (17 bytes a pair).

    Null and empty texts, and those whose tokens' bytes differ from a space and the text, have zeros and an empty digest.
    Repeated rows count and stay as often as they occur, a null doc_id stays null, texts of any length are encoded whole,
    and an empty table stays empty. A column of the given name is replaced; `text` goes, all others stay.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    own, *_ = spare(docs, 1)
    docs.withColumn(own, _aligner(path_a, path_b)("text")).drop("text", column).write.option("compression", "zstd").parquet(folder)
    kept = spark.read.parquet(folder)
    table = pair_counts(kept.select(f"{own}.pairs", f"{own}.times")).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(np.append(table[c].to_numpy(), fill) for c, fill in (("pair", -1), ("n", 0), ("top", False))))
    @arrow_udf("n_best bigint, count_sum bigint")
    def weigh(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pair, n, top = known.value
        pair, top = pair[:-1], top.astype(np.int64)
        for pairs, times in batches:
            at, k = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
            edges = np.append(0, pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False)).cumsum()
            sums = [np.append(0, x.cumsum())[edges] for x in (top[at] * k, n[at] * k)]
            yield pa.StructArray.from_arrays([pa.array(np.diff(x), pa.int64()) for x in sums], names=["n_best", "count_sum"])

    weighed = kept.withColumn(column, weigh(f"{own}.pairs", f"{own}.times"))
    fields = [F.col(f"{own}.{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return weighed.withColumn(column, F.struct(*fields, F.col(f"{column}.n_best").alias("n_best"), F.col(f"{column}.count_sum").alias("count_sum"), F.col(f"{own}.groups_sha256").alias("groups_sha256"))).drop(own)
