"""Token ids of all documents as Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodeglass.llm.shared import WordEncoder, open_store, shared_folder, texts


def file_schema(length: int, dtype: str) -> pa.Schema:
    """One row a sequence: its ids and two masks of fixed size, and the documents that begin in it, in order."""
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)),
        ("used", pa.list_(pa.bool_(), length)),
        ("first", pa.list_(pa.bool_(), length)),
        ("doc_ids", pa.list_(pa.int64())),
    ])


class _Writer:
    """Fills sequences from documents and writes `rows` of them a record batch."""

    def __init__(self, path: str, length: int, rows: int, dtype: str) -> None:
        self.schema, self.length, self.want, self.dtype = file_schema(length, dtype), length, length * rows, dtype
        store, at = open_store(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.sink = store.open_output_stream(at)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts, self.begins, self.docs, self.held, self.tokens = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.begins.append(self.held)
        self.docs.append(doc_id)
        self.parts.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.want:
            self._flush(self.held // self.want * self.want)

    def _flush(self, most: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        begins = np.array(self.begins, np.int64)
        for low in range(0, most, self.want):
            part = ids[low : min(low + self.want, len(ids))]
            n = -(-len(part) // self.length)
            flat, used, first = np.zeros(n * self.length, self.dtype), np.zeros(n * self.length, bool), np.zeros(n * self.length, bool)
            flat[: len(part)], used[: len(part)] = part, True
            a, b = np.searchsorted(begins, [low, low + self.want])
            first[begins[a:b] - low] = True
            edges = np.searchsorted(begins[a:b] - low, np.arange(n + 1) * self.length)
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(used), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(first), self.length),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(self.docs[a:b], pa.int64())),
            ], schema=self.schema))
        a = int(np.searchsorted(begins, most))
        self.parts, self.begins, self.docs, self.held = [ids[most:]], list(begins[a:] - most), self.docs[a:], max(0, len(ids) - most)

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.out.close()
        self.sink.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, length: int = 2048, rows: int = 256, end_id: int = 2) -> list[tuple[str, int, int]]:
    """Writes the ids of every whole text, each followed by `end_id`, in ascending doc_id order.

    Documents are dealt out by ranges of doc_id, and each range is one file in Arrow's IPC file format, uncompressed:
    its footer finds any record batch, each batch holds `rows` sequences of `length` ids, so that sequence i of a file
    lies in batch i // rows and can be used where the file is mapped, without a copy. Ids take 16 bits where the
    vocabulary allows, masks one bit. Only the last sequence of a file is padded (`used` is false there).

    A file's name holds its attempt's own id, and only the files of attempts that ended well are returned, as
    (path, ids, documents) in order; one small row a file comes to the driver. Null texts are empty (their only id is
    end_id); a null doc_id comes first; equal doc_ids stand side by side, by their texts; an empty table gives no file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = None, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if out is None:
                    dtype = "<u2" if WordEncoder(tokenizer_path).size <= 1 << 16 and end_id < 1 << 16 else "<u4"
                    encode, n, part = WordEncoder(tokenizer_path, dtype=dtype), 0, TaskContext.get().partitionId()
                    out = _Writer(path := f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.arrow", length, rows, dtype)
                    end = np.array([end_id], dtype).tobytes()
                out.add(doc_id, np.frombuffer(encode(text) + end, dtype))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "ids": out.tokens, "docs": n}])

    dealt = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = dealt.mapInArrow(run, "part bigint, path string, ids bigint, docs bigint").collect()
    return [(r.path, r.ids, r.docs) for r in sorted(found)]


def read_sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the i-th sequence of a local file, the ids as a view of the mapped file."""
    file = pa.ipc.open_file(pa.memory_map(path))
    rows = file.get_batch(0).num_rows
    batch, k = file.get_batch(i // rows), i % rows
    length = batch.schema.field("ids").type.list_size
    ids = batch["ids"].values.slice((batch["ids"].offset + k) * length, length).to_numpy(zero_copy_only=True)
    return ids, batch["used"].values.slice((batch["used"].offset + k) * length, length).to_numpy(zero_copy_only=False)


def documents_of(path: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, ids before it in the file, ids, crc32 of them as unsigned 32-bit integers) of each document in a file, a batch at a time."""
    store, at = open_store(path)
    with store.open_input_file(at) as source:
        file = pa.ipc.open_file(source)
        doc, start, crc, before, some = None, 0, 0, 0, False
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            used = batch["used"].flatten().to_numpy(zero_copy_only=False)
            ids = batch["ids"].flatten().to_numpy()[used]
            first = np.flatnonzero(batch["first"].flatten().to_numpy(zero_copy_only=False)[used])
            ids = ids.astype("<u4")
            crc = zlib.crc32(ids[: first[0] if len(first) else len(ids)], crc)
            for a, b, found in zip(first, [*first[1:], len(ids)] if len(first) else [], batch["doc_ids"].flatten().to_pylist(), strict=True):
                if some:
                    yield doc, start, before + int(a) - start, crc
                doc, start, crc, some = found, before + int(a), zlib.crc32(ids[a:b]), True
            before += len(ids)
        if some:
            yield doc, start, before - start, crc


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    before, table = 0, []
    for path, ids, _ in files:
        table.append((path, before))
        before += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                for doc, start, n, crc in documents_of(row["path"]):
                    held.append((doc, row["before"] + start, n, crc))
                    if len(held) == 20_000:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    paths = spark.createDataFrame(table, "path string, before bigint").repartition(max(1, len(table)))
    return paths.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [[]] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder and returns what they hold of each document."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, shared_folder(spark), tokenizer_path, length, end_id=end_id))
