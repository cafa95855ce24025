import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeglass.llm import alignment
from lodeglass.llm.shared import BYTE_CHARS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
FIRST.encode_special_tokens = True
BACK = {c: b for b, c in BYTE_CHARS.items()}


def plain(text):
    """(a, their ends, b, their ends) by the libraries alone, or None."""
    if not text:
        return None
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    bytes_a = [bytes(BACK[c] for c in FIRST.id_to_token(x)) for x in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if SECOND.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [SECOND.id_to_piece(x)]]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    return a, np.cumsum([len(x) for x in bytes_a]).tolist(), b, np.cumsum([len(x) for x in bytes_b]).tolist()


def brute(texts):
    """All rows by sets of ends and plain loops."""
    found, count = [plain(t) for t in texts], Counter()
    links = [[(f[0][i], f[2][bisect_left(f[3], e)]) for i, e in enumerate(f[1]) if e in set(f[3])] if f else [] for f in found]
    for x in links:
        count.update(x)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for f, x in zip(found, links, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = [0, *sorted(set(f[1]) & set(f[3]))]
        groups = [",".join(str(i) for i, e in zip(f[0], f[1]) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(f[2], f[3]) if low < e <= high) for low, high in zip(cuts, cuts[1:])]
        out.append((len(f[0]), len(f[2]), len(groups), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "Hello,", " world's", "<|endoftext|>", "</s>", "<s>", "▁", " ▁x", "1234", "café", "é", " ", "　 ", "\U0001f600", "日本語", "...", "!? ", "x\u0085 y", "\x1c ", "<0x0A>", "antidisestablishment", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_ids_of_pieces_are_those_of_the_libraries():
    encode = alignment.PairEncoder(A, B, most=60)
    assert not encode.whole
    texts = [*random_texts(1500), "", "a", " a", "a ", " ", "  a  b ", "x" * 5000]
    for low in range(0, len(texts), 100):
        for text, got in zip(texts[low : low + 100], encode(texts[low : low + 100]), strict=True):
            want = plain(text)
            assert (got is None) == (want is None), repr(text)
            assert got is None or ([*got[0]], [*got[1]]) == (want[0], want[2]), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3))))
def test_groups_are_the_common_ends(steps):
    at, a, b = 0, [], []
    for width, side in steps:
        at += width
        a += [at] * (side in (0, 1))
        b += [at] * (side in (0, 2, 3))
    at += 1
    a, b = [*a, at], [*b, at]
    last_a, last_b = alignment.token_groups(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i] for i in last_a] == common == [b[i] for i in last_b]


def test_long_runs_and_shifts():
    a, b = [*range(1, 1000), 1003, *range(1004, 3000)], [*range(1, 1000), 1001, 1002, 1003, *range(1004, 3000)]
    last_a, last_b = alignment.token_groups(a, b)
    assert [*last_a] == [*range(len(a))] and [*last_b] == [*range(999), *range(1001, len(b))]


@pytest.fixture(scope="module")
def texts():
    return [None, "", *random_texts(60, 8), "The same text here.", "The same text here.", "word and number 12 " * 2000]


def test_rows_equal_brute_force(spark, docs_of, texts):
    docs = docs_of(texts, ids=[None, 3, 3, *range(3, len(texts))]).withColumnRenamed("ids", "PAIRS").withColumnRenamed("start", "n_best")
    got = alignment.with_alignment(docs.repartition(5), A, B, "source").collect()
    rows = sorted(((r.doc_id, *r.source) for r in got), key=repr)
    assert rows == sorted(((d, *w) for d, w in zip([None, 3, 3, *range(3, len(texts))], brute(texts), strict=True)), key=repr)
    assert set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "PAIRS", "n_best"}


def test_rows_of_nothing(spark, docs_of):
    assert alignment.with_alignment(docs_of(["x"]).filter("false"), A, B).count() == 0
    got = alignment.with_alignment(docs_of([None, ""]), A, B).collect()
    assert [tuple(r.alignment) for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pairs_are_suffixes():
    """The bound of the table of counts: of two linked tokens one ends the other."""
    encode = alignment.PairEncoder(A, B)
    first, second = {t for t in encode.bytes_a if t}, {t for t in encode.bytes_b if t}
    most = sum(t[k:] in second for t in first for k in range(len(t))) + sum(t[k:] in first for t in second for k in range(1, len(t)))
    assert most < 500_000
