import random
import re
import time

import numpy as np
import pytest

from lodeglass.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(width, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "ça", "42", "x", "naïve", "ΑΒ"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([4, 6, 2, 1, 9, 5])] + [(10, None), (11, "!!"), (12, "beta, beta"), (2, "x x x x")]
    texts = [rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(25))) for _ in range(60)] + [None, "", "?!", "ALPHA beta " * 4000, items[1][1].upper()]
    return items, texts


def test_hits_equal_brute_force(spark, docs_of, cases):
    items, texts = cases
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as items")
    got = {r.doc_id: r for r in decontamination.with_passages(docs_of(texts), benchmark, width=4).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None or len(t) < 1000:
            p = got[i].passages
            assert (p.n_words, p.n_hit, p["items"]) == brute(t, items, 4), t
            if p.n_hit:
                assert sum(len(split(t[s.first : s.after])) for s in p.spans) == p.n_hit
                assert all(a.after < b.first for a, b in zip(p.spans, p.spans[1:], strict=False))


def test_random_windows_of_every_width():
    rng = random.Random(5)
    for case in range(300):
        width, letters = rng.randint(1, 7), "abc"[: rng.randint(1, 3)]
        line = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randrange(n)))  # noqa: B023, E731
        items = [(i % 4, line(14)) for i in range(rng.randrange(6))]
        passages = decontamination.Passages([(str(i), decontamination.words(t)) for i, t in items], width)
        for text in (line(30) for _ in range(6)):
            got = decontamination.scan(text, passages)
            assert (got["n_words"], got["n_hit"], got["items"]) == brute(text, items, width), (case, items, text)


def test_windows_of_one_hash(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: len(x) % 3)
    items = [(1, "a b c d"), (2, "b c d e"), (3, "a b c d"), (4, "e e")]
    passages = decontamination.Passages([(str(i), decontamination.words(t)) for i, t in items], 3)
    for text in ("x a b c x", "b c d", "c d e e", "a b d"):
        got = decontamination.scan(text, passages)
        assert (got["n_words"], got["n_hit"], got["items"]) == brute(text, items, 3)


def test_two_million_words():
    """One automaton, within the memory that the docstring states, and documents of many words in little time."""
    rng = np.random.default_rng(1)
    size = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1e3  # noqa: E731, SIM115
    vocabulary = [f"w{i}".encode() for i in range(200_000)]
    items = [(str(k), [vocabulary[i] for i in rng.integers(0, 200_000, 200)]) for k in range(10_000)]
    before = size()
    passages = decontamination.Passages(items, 10)
    assert size() - before < 600
    text = " ".join(w.decode() for w in [vocabulary[i] for i in rng.integers(0, 200_000, 100_000)] + items[77][1][31:52])
    began = time.process_time()
    got = decontamination.scan(text, passages)
    assert (got["n_hit"], got["items"]) == (21, ["77"]) and time.process_time() - began < 5


def test_long_items_and_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 50)
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(400)}" for _ in range(1200))
    texts = ["x " * 5000 + item + " y" * 5000, item[400:3000], " ".join(item.split()[45:57]), " ".join(item.split()[45:54]), "z " * 300_000]
    got = sorted(decontamination.with_passages(docs_of(texts), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect())
    assert [r.passages.n_hit for r in got][:1] == [1200] and [(r.passages.n_words, r.passages.n_hit, r.passages["items"]) for r in got[1:4]] == [brute(t, [(7, item)], 10) for t in texts[1:4]]
    assert got[3].passages.n_hit == 0 and got[4].passages.n_words == 300_000 and got[4].passages.n_hit == 0


def test_columns_of_any_name_stay(spark, docs_of):
    odd = docs_of(["one two three", None]).selectExpr("*", "1 as passages", "2 as `a.b`", "3 as found", "4 as own0")
    got = decontamination.with_passages(odd, spark.createDataFrame([(1, "two three")], "item_id bigint, text string"))
    assert got.columns == odd.columns and sorted(r.passages.n_hit for r in got.collect()) == [0, 2]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.passages.n_hit for r in decontamination.with_passages(docs_of(["a b", None]), none).collect()] == [0, 0]
    assert decontamination.with_passages(docs_of([]), none).collect() == []
