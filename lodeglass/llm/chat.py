"""Conversations rendered under a template, encoded once with offsets, with loss masks aligned to tokens."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks: of a turn's begin, its text's begin and its end. Each is a token of its own, so that no token reaches over a text's edges.
BEGIN, SAYS, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """The text without any `<|`: each `<`, backslashes and `|` get one more backslash."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn under the template, and where its text begins and ends there."""
    head, body = BEGIN + escape(role) + SAYS, escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of what `render` has put together."""
    for m in _TURN.finditer(rendered):
        yield unescape(m[1]), unescape(m[2])


def chat_tokenizer(path: str):
    """The byte-level tokenizer of a file, with the template's marks as tokens of their own and offsets of whole characters."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BEGIN, SAYS, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def token_bytes(tokenizer) -> list[bytes]:
    """What each id of a byte-level tokenizer stands for; marks stand for themselves."""
    from lodeglass.llm.shared import BYTE_CHARS

    byte_of, names = {c: b for b, c in BYTE_CHARS.items()}, tokenizer.get_vocab()
    out, marks = [b""] * (max(names.values()) + 1), set(tokenizer.get_added_tokens_decoder())
    for name, i in names.items():
        out[i] = name.encode() if i in marks else bytes(byte_of[c] for c in name)
    return out


def masked_texts(ids: np.ndarray, loss: np.ndarray, known: list[bytes]) -> Iterator[str]:
    """The text that each run of tokens under the mask stands for."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]]).astype(np.int8)))
    for i, j in zip(turns[::2], turns[1::2], strict=True):
        yield unescape(b"".join(map(known.__getitem__, ids[i:j].tolist())).decode())


def align(spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For sorted character spans and sorted token spans: (first token, token after the last) and the characters of each that those tokens cover, whole tokens always."""
    tokens, chars = [], []
    for a, b in spans:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if a < b and i < j:
            tokens.append((i, j))
            chars.append((starts[i], ends[j - 1]))
    return tokens, chars


SEGMENTS = "conv_id bigint, part bigint, segment bigint, text string, ids binary, loss binary, loss_spans array<struct<first:int,after:int>>"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("loss", pa.binary()), ("loss_spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))])


def format_conversations(turns: DataFrame, tokenizer_path: str, segment_chars: int = 100_000) -> DataFrame:
    """Renders whole conversations and encodes them once, with a loss mask over the assistants' texts.

    Rows (conv_id, turn, role, text) are dealt out by ranges of (conv_id, turn), so that a conversation of any length
    spreads over tasks; each task streams its rows in order of turn, role, text. A conversation comes out as segments
    of at least `segment_chars` characters but for its last ones, always cut between turns, where a mark begins the
    next one, so that its tokens are those of the whole. Segments order by (part, segment).

    Returns per segment: its rendered text, token ids (little-endian unsigned 32-bit), one loss byte a token, and the
    character spans of the tokens under the mask: those that meet an assistant's text, found by binary search. The
    template's marks are tokens, so these tokens hold that text and nothing else.
    Null texts and roles are empty; a null conv_id is a conversation of its own, null turns come first; repeated rows
    are turns like others; control strings in texts and roles are escaped reversibly. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_path)
        part, segment, now, chars, pieces, spans, out, size = TaskContext.get().partitionId(), 0, None, 0, [], [], [], 0

        def close() -> None:
            nonlocal segment, chars, pieces, spans, size
            text = "".join(pieces)
            found = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
            tokens, loss_spans = align(spans, offsets[:, 0].tolist(), offsets[:, 1].tolist())
            loss = np.zeros(len(offsets), np.uint8)
            for i, j in tokens:
                loss[i:j] = 1
            out.append({"conv_id": now[0], "part": part, "segment": segment, "text": text, "ids": np.array(found.ids, "<u4").tobytes(), "loss": loss.tobytes(), "loss_spans": [{"first": a, "after": b} for a, b in loss_spans]})
            size += len(text)
            segment, chars, pieces, spans = segment + 1, 0, [], []

        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if pieces and (now != (conv_id,) or chars >= segment_chars):
                    close()
                now = (conv_id,)
                turn, a, b = render(role, text)
                if role == "assistant":
                    spans.append((chars + a, chars + b))
                pieces.append(turn)
                chars += len(turn)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, _SEGMENTS)
                    out, size = [], 0
        if pieces:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _SEGMENTS)

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def conversation_digests(segments: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the segments hold of each conversation, read back from them: turns from the rendered text, and the text that the token ids under the loss mask stand for.

    A digest runs over a conversation from its first turn to its last. Segments arrive in order and are hashed one
    after another in one task, so that a conversation of any length takes the memory of one segment. A conversation
    without assistants has no loss characters; no segments give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, known = None, [], token_bytes(chat_tokenizer(tokenizer_path))

        def close() -> None:
            out.append({"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

        first = True
        for batch in batches:
            for conv_id, text, ids, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "ids", "loss")), strict=True):
                if first or conv_id != now:
                    if not first:
                        close()
                    first, now, n, chars, size, turns, loss = False, conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                size += len(text)
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for part in masked_texts(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8), known):
                    chars += len(part)
                    loss.update(part.encode())
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, _DIGESTS)
                out.clear()
        if not first:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)

    rows = segments.select("conv_id", "part", "segment", "text", "ids", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(run, DIGESTS)
