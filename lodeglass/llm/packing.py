"""Cost-balanced packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.shared import WordEncoder, cut, texts

#: Room is looked up by steps of so many tokens.
STEP = 64


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float, all_of_it: bool = False) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Places pieces of the given documents in sequences that all become full.

    A piece of n tokens costs linear * n + quadratic * n * n. Pieces go, longest first, to the sequence of lowest cost
    among those with room for them whole; where none has, to that of lowest cost with any room, cut to it, and what is
    left of them goes on as a piece of its own length. There are as many sequences as the tokens fill, so what remains
    at the end is less than `capacity`. With `all_of_it` one more sequence, as short as that, takes it.

    Returns (document, start, length, sequence, offset) of placed pieces, (document, start, length) of the others, and
    the number of sequences.
    """
    placed, heap, count = [], [], 0
    for k, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            placed.append((k, at, capacity, count, 0))
            at, count = at + capacity, count + 1
        if at < n:
            heap.append((at - n, k, at))
    heapq.heapify(heap)
    total = -sum(x[0] for x in heap)
    sizes = [capacity] * (total // capacity) + [total % capacity] * (all_of_it and total % capacity > 0)
    room = {count + i: n for i, n in enumerate(sizes)}
    classes: list[list] = [[] for _ in range(capacity // STEP + 1)]
    for s, n in room.items():
        heapq.heappush(classes[n // STEP], (0.0, s))
    while heap:
        n, k, at = heapq.heappop(heap)
        n = -n
        fitting = [c for c in range(-(-n // STEP), len(classes)) if classes[c]]
        if n % STEP and classes[c := n // STEP] and room[classes[c][0][1]] >= n:
            fitting.append(c)
        fitting = fitting or [c for c in range(len(classes)) if classes[c]]
        if not fitting:
            heapq.heappush(heap, (-n, k, at))
            break
        c = min(fitting, key=lambda c: classes[c][0])
        cost, s = heapq.heappop(classes[c])
        size = min(n, room[s])
        placed.append((k, at, size, s, sizes[s - count] - room[s]))
        room[s] -= size
        if size < n:
            heapq.heappush(heap, (size - n, k, at + size))
        if room[s]:
            heapq.heappush(classes[room[s] // STEP], (cost + linear * size + quadratic * size * size, s))
    return placed, [(k, at, -n) for n, k, at in heap], count + len(sizes)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096, block: int = 8_000_000, pool: int = 64, with_ids: bool = False) -> DataFrame:
    """Packs all documents (null text: empty) into sequences of at most `capacity` tokens.

    Each task packs the documents it reads, `block` tokens at a time, into sequences that it fills to the last token;
    no text is shuffled. What is left of a block, less than one sequence, opens the next one; what is left of a task
    meets that of up to `pool` tasks in a second, small step, which alone can leave a sequence part empty. So at most
    one sequence in `pool` tasks is padded.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` its
    ids as little-endian unsigned 32-bit integers (else null). Each id of a document lies in exactly one piece; a
    document has end_id as its last id, so an empty one has one piece. Repeated rows are packed as often as they occur,
    and a null doc_id stays null. An empty table gives no rows.
    """
    def rows(pieces: list[tuple], held: list[tuple], base: int) -> pa.RecordBatch:
        out = []
        for k, at, n, s, offset in pieces:
            doc_id, begin, ids, total = held[k]
            part = ids[4 * at : 4 * (at + n)]
            out.append((doc_id, begin + at, n, zlib.crc32(part), total, None if s is None else base + s, offset, part if with_ids or s is None else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _SCHEMA, strict=True)] if out else [pa.array([], t.type) for t in _SCHEMA], schema=_SCHEMA)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = None, np.array([end_id], "<u4").tobytes()
        held, size, base = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, base
            placed, left, n = assign([len(x[2]) // 4 for x in held], capacity, linear, quadratic)
            for a in range(0, len(placed), 20_000):
                yield rows(placed[a : a + 20_000], held, base)
            base += n
            held = [(held[k][0], held[k][1] + at, held[k][2][4 * at : 4 * (at + n)], held[k][3]) for k, at, n in sorted(left)]
            size = sum(len(x[2]) // 4 for x in held)

        for batch in batches:
            encode = encode or WordEncoder(tokenizer_path)
            base = base or TaskContext.get().partitionId() << 32
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + end
                held.append((doc_id, 0, ids, len(ids) // 4))
                size += len(ids) // 4
                if size >= block:
                    yield from flush()
        if held:
            yield from flush()
            yield rows([(k, 0, len(x[2]) // 4, None, None) for k, x in enumerate(held)], held, base)

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = sorted(((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in table.to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
        placed, _, _ = assign([len(x[2]) // 4 for x in held], capacity, linear, quadratic, all_of_it=True)
        return pa.Table.from_batches([rows(placed, held, 1 << 62 | key[0].as_py() << 32)])

    packed = cut(texts(docs).mapInArrow(fill, _DDL).withColumn("pool", F.when(F.col("sequence_id").isNull(), F.spark_partition_id() / F.lit(pool)).cast("bigint")))
    rest = packed.filter("pool is not null").groupBy("pool").applyInArrow(lambda key, t: finish(key, t.drop(["pool"])), _DDL)
    return packed.filter("pool is null").drop("pool").unionByName(rest)
