"""What several operators need: the shared folder, words as bytes, and a memoising encoder."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors and the driver see.

    Only where that setting is missing in a local session (as in a test) a temporary folder takes its place; on a
    cluster its absence is an error, as executors would not see the driver's folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver see")
        top = getattr(shared_folder, "fallback", None) or tempfile.mkdtemp(prefix="spark-")
        shared_folder.fallback = top
    return f"{top.rstrip('/')}/lodeglass-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store Spark finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short lineage, held in the shared folder until nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession))
    return df.checkpoint()


def spare(df: DataFrame, n: int) -> list[str]:
    """So many column names that the table has not, in whatever case."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"own{i}{tail}" in taken for i in range(n)):
        tail += "_"
    return [f"own{i}{tail}" for i in range(n)]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def open_store(uri: str):
    """(pyarrow file system, path there) of a folder or file that Spark names by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri)) if ":" in uri else (fs.LocalFileSystem(), uri)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and no other column but those in `more`."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: UTF-8 bytes to what words are made of: A-Z lower-cased, other ASCII but letters and digits as spaces, the rest as it is.
_WORD_BYTES = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: runs of characters that are digits, letters or not ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixing of uint64 values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """Words to 64-bit hashes, remembering the last ones seen; memory is bounded by `most` words."""

    def __init__(self, most: int = 600_000) -> None:
        import xxhash

        super().__init__()
        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        self[word] = h = self.digest(word)
        return h

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: Byte to character of byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ODD_SPACES = re.compile("[\x1c-\x1fΣİ]")
_CORE = re.compile(r"([^\W\d_]+)([^\w\s'<|>]*)")


class WordEncoder(dict):
    """Token ids of whole texts under a word-end BPE vocabulary of the tokenizers library.

    Its normaliser and splitter never join what white space separates, so a text's ids are those of its pieces, one
    after another. Pieces are remembered, `most` twice, so that the library is asked once for each and not once per
    occurrence: pieces of letters and following punctuation go to the vocabulary's BPE model, all others through the
    whole tokenizer. Texts with characters where Python's white space or lower case differs go through it whole.
    """

    def __init__(self, path: str, most: int = 600_000, dtype: str = "<u4") -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most, self.old, self.kind = most, {}, {"<u4": "I", "<u2": "H"}[dtype]
        self.size = self.tokenizer.get_vocab_size()

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, core: str) -> bytes:
        chars = core if core.isascii() else "".join(map(BYTE_CHARS.__getitem__, core.encode()))
        return array(self.kind, [t.id for t in self.model.tokenize(chars)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            m = _CORE.fullmatch(piece)
            if not m or not (piece.isascii() or m[1].isalpha() and unicodedata.is_normalized("NFC", piece)):
                ids = self._whole(piece)
            elif m[2]:
                ids = self[m[1]] + self[m[2]]
            else:
                ids = self._letters(piece)
        self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian ids of the text, without an end id."""
        if _ODD_SPACES.search(text) or "<|" in text:
            return self._whole(text)
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))
