import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeglass.llm import packing, token_file
from lodeglass.llm.shared import WordEncoder, shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello there, Hello!", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>", None, "", "a b c " * 3000, "Ünïcode café ΣΑΣ <|endoftext|> it's 12½", "Hello there, Hello!", "word " * 40] + [f"Text number {i} says {'blah ' * (i % 50)}" for i in range(60)]


TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    encode, rng = WordEncoder(PATH, most=50), random.Random(7)
    letters = [chr(c) for c in [*range(9, 1500), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), 0x1F600]]
    for _ in range(800):
        text = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice([*"ab '.<|>,s tlle", "<|endoftext|>", "<|startoftext|>"]) for _ in range(14))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text)[:-1], text


@pytest.mark.parametrize("length", [7, 2048])
def test_token_files_round_trip(spark, docs_of, length):
    docs = docs_of(TEXTS, ids=[3 * i % 67 for i in range(len(TEXTS))])
    got = sorted(tuple(r) for r in token_file.token_index(docs, PATH, length).collect())
    want, before = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = plain(r.text)
        want.append((r.doc_id, before, len(ids), crc(ids)))
        before += len(ids)
    assert got == want


def test_sequences_by_number(spark, docs_of):
    files = token_file.write_token_files(docs_of(TEXTS), shared_folder(spark), PATH, 16, rows=4)
    stream = [x for t in TEXTS for x in plain(t)]
    got = []
    for path, ids, _ in files:
        for i in range(-(-ids // 16)):
            part, used = token_file.read_sequence(path.removeprefix("file:"), i)
            assert len(part) == 16
            got += part[used].tolist()
    assert got == stream


def test_token_files_of_nothing(spark, docs_of):
    assert token_file.token_index(docs_of([]), PATH).collect() == []


def check_packing(rows, docs, capacity):
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append(plain(r.text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc_id, texts in want.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == crc(texts[0][at : at + r.length])
                at += r.length
            assert at == len(texts[0])
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in parts) for parts in sequences.values()]


@pytest.mark.parametrize(("capacity", "block"), [(4096, 8_000_000), (256, 1000)])
def test_packing_holds_each_id_once(spark, docs_of, capacity, block):
    docs = docs_of(TEXTS, ids=[None, *range(1, len(TEXTS) - 1), 5])
    fills = check_packing(packing.pack(docs, PATH, capacity, block=block).collect(), docs.collect(), capacity)
    assert sum(f < capacity for f in fills) <= 1


def test_packing_of_nothing(spark, docs_of):
    assert packing.pack(docs_of([]), PATH).collect() == []


def test_assign_prefers_low_cost_and_balances():
    placed, left, n = packing.assign([60, 50, 40, 30, 20], 100, 1.0, 0.01)
    assert n == 2 and sum(x[2] for x in left) == 0
    first = [x for x in placed if x[1] == 0][:2]
    assert {x[0] for x in first} == {0, 1} and first[0][3] != first[1][3]


def test_costs_are_spread_more_evenly_than_by_first_fit():
    """Lengths of real documents: the same pieces, longest first, into the first sequence with room, cost less evenly."""
    import pyarrow.parquet

    texts = pyarrow.parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = [len(plain(t)) for t in texts]
    cost = lambda n: n + n * n / 4096
    placed, _, count = packing.assign(lengths, 4096, 1.0, 1 / 4096, all_of_it=True)
    ours, whole = np.zeros(count), np.zeros(count)
    for _, _, n, s, _ in placed:
        ours[s] += cost(n)
        whole[s] += n
    assert sum(whole) == sum(lengths) and (whole == 4096).sum() >= count - 1
    rooms, first = [], []
    for n in sorted((n for _, _, n, _, _ in placed), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if at == len(rooms):
            rooms.append(4096)
            first.append(0.0)
        rooms[at] -= n
        first[at] += cost(n)
    shared = ours[[s for s in range(count) if whole[s] == 4096 and ours[s] < 2 * 4096]]
    print(f"spread of costs: {shared.std():.0f}, by first fit {np.std([c for c in first if c < 2 * 4096]):.0f}; sequences {count} and {len(first)}")
    assert shared.std() < np.std([c for c in first if c < 2 * 4096])
