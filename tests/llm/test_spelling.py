import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodeglass.llm import spelling


def brute_counts(docs, shortest=5, least=3):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += len(run) >= shortest
    return {w: n for w, n in count.items() if n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    forms, rows = {}, {}
    close = defaultdict(list)
    for a in words:
        close[a] = [b for b in words if near(a, b)]
        best = min(close[a], key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 2 * words[a]:
            forms[a] = best
    for a, n in words.items():
        root = a
        while root in forms:
            root = forms[root]
        rows[a] = (n, len(close[a]), forms.get(a), words.get(forms.get(a)), root)
    return rows


def found(spark, words, parts=3):
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(parts)
    got = spelling.variants(table).collect()
    assert len(got) == len(words)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}


@pytest.mark.parametrize("letters, parts", [("ab", 1), ("abà", 7), ("abcdefghÿ", 20)])
def test_variants_equal_brute_force(spark, letters, parts):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): int(3 * 2 ** rng.uniform(0, 8)) for _ in range(400)}
    assert found(spark, words, parts) == brute(words)


def test_long_chain_ends_at_its_root(spark):
    words = {"x" * k + "y" * (40 - k): 3 * 2**k for k in range(0, 24)}
    assert found(spark, words) == brute(words)
    assert found(spark, words)["y" * 40][4] == "x" * 23 + "y" * 17


def test_ties_and_long_words(spark):
    long = "ab" * 20_000
    words = {"hello": 4, "hallo": 8, "hullo": 8, "hell": 8, "helloo": 8, long: 3, long + "a": 9}
    assert found(spark, words)["hello"] == (4, 4, "hallo", 8, "hallo")
    assert found(spark, words)[long] == (3, 1, long + "a", 9, long + "a")


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = spelling.trie_nodes(table, table.word, "id", "nodes").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.word for r in sorted(got, key=lambda r: r.id)] == words
    numbers = {}
    for r in got:
        for k, x in enumerate(r.nodes):
            assert numbers.setdefault(r.word[: k + 1], x) == x
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1))


def test_words_of_documents(spark, docs_of):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeÀéÿ×ABCD") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    texts = [None, "", "1234", "ÀÀÀÀÀ-ÀÀÀÀÀ_ÀÀÀÀÀĀààààà", "same words twice", "same words twice", "z" * 200_000 + " " + "z" * 200_000, *texts]
    ids = [None, 1, 1, None, None, *range(7, len(texts) + 2)]
    got = {r.word: r.n for r in spelling.word_counts(docs_of(texts, ids=ids).repartition(5)).collect()}
    want = brute_counts(list(zip(ids, texts, strict=True)))
    assert got == want and len(want) > 60
    assert spelling.variants(spelling.word_counts(docs_of(texts).filter("false"))).count() == 0
