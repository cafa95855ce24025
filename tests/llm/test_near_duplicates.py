import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeglass.llm import near_duplicates as nd
from lodeglass.llm.shared import WordHasher, words


def plain_similarity(a, b):
    """Probability Jaccard by its definition, over dictionaries of shingle counts."""
    def counts(t):
        w = words(t)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))

    x, y = counts(a), counts(b)
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in x.keys() & y.keys())


def plain_classes(rows, least=0.8):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a and b and (words(a) == words(b) if words(a) and words(b) else a == b or False) or (a and b and words(a) and words(b) and plain_similarity(a, b) >= least):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return sorted((d, min(g), len(g)) for g in groups.values() for d in g)


def varied(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    texts = []
    for _ in range(12):
        base = fresh(rng.choice([60, 150, 400]))
        texts += [base, base.upper() + "!", *(varied(rng, base, rng.choice([1, 1, 2, 8, 40])) for _ in range(4))]
    hub = fresh(300)
    texts += [varied(rng, hub, k) for k in (3, 5, 7, 9, 4, 6, 8, 2)]
    line = fresh(12) + "\n"
    texts += [line * 10, line * 10 + fresh(3), line * 4, "one two", "One, two", "three", None, "", "", "?!", "?!", "?", fresh(6000)]
    texts += [fresh(80) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_similarity_equals_its_definition_and_components_estimate_it():
    rng, hasher = random.Random(2), WordHasher()
    for _ in range(60):
        a = " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        b = " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        assert np.isclose(nd.similarity(nd.shingles(hasher(words(a))), nd.shingles(hasher(words(b)))), plain_similarity(a, b))
    draw, agree, want = np.random.default_rng(3), [], []
    for _ in range(150):
        x = draw.integers(0, 2**62, 60).astype(np.uint64)
        a, b = np.concatenate([x, x[:20]]), np.concatenate([x[:45], draw.integers(0, 2**62, 10).astype(np.uint64)])
        s = nd.signatures([a, b])
        agree.append((s[0] == s[1]).mean())
        want.append(nd.similarity(a, b))
    assert abs(np.mean(agree) - np.mean(want)) < 0.015


def test_classes_equal_brute_force(spark, docs_of, corpus):
    got = sorted((r.doc_id, r.class_id, r.class_rows) for r in nd.classes(docs_of([t for _, t in corpus])).collect())
    assert got == plain_classes(corpus)


def test_one_document_of_each_class_stays(spark, docs_of, corpus):
    docs = docs_of([t for _, t in corpus])
    kept = sorted(r.doc_id for r in nd.one_of_each(docs).collect())
    assert kept == sorted({c for _, c, _ in plain_classes(corpus)})
    assert nd.one_of_each(docs).columns == docs.columns
    twice = docs_of(["same text here again and again", "same text here again and again", None, None, "other"], ids=[1, 1, None, 4, 1])
    assert sorted((r.doc_id or -1, r.text or "") for r in nd.one_of_each(twice).collect()) == [(-1, ""), (1, "other"), (1, "same text here again and again"), (4, "")]


def test_no_documents(spark, docs_of):
    assert nd.classes(docs_of([])).collect() == [] and nd.one_of_each(docs_of([])).collect() == []
    assert [r.class_id for r in nd.classes(docs_of([None])).collect()] == [0]


def test_components_of_odd_graphs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(300, 300)]
    key = lambda i: i.to_bytes(2, "big")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in nd.components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")).collect()}
    low = {i: i for e in edges for i in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {i: got.get(i, i) for i in low} == low


def counts_of(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))


def test_links_of_every_tenth_document_are_found(spark):
    """Recall over real rows: every tenth document against all others, through an index of shingles, exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    of = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    texts = {r.doc_id: counts_of(r.text) for r in docs.collect()}
    where = defaultdict(set)
    for i, c in texts.items():
        for s in c:
            where[s].add(i)
    similar, near = [], 0
    for i in (i for i in texts if i % 10 == 0):
        for j in set().union(*(where[s] for s in texts[i])) - {i}:
            x, y = texts[i], texts[j]
            every = x.keys() | y.keys()
            value = sum(1 / sum(max(x[k] / x[s], y[k] / y[s]) for k in every) for s in x.keys() & y.keys()) if len(every) < 3 * len(x.keys() & y.keys()) else 0
            similar += [(i, j)] * (value >= 0.8)
            near += 0.6 <= value < 0.8
    found = sum(of[i] == of[j] for i, j in similar)
    print(f"pairs of 0.8 or more: {len(similar)}, in one class: {found}; pairs of 0.6 to 0.8: {near}")
    assert len(similar) > 10 and found == len(similar)


def test_long_texts_and_many_near_copies(spark, docs_of):
    """A group of near copies larger than a tile, whose members are alike in pairs only, and texts of 60,000 words."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = fresh(120), []
    for _ in range(330):
        own = list(base)
        for at in rng.sample(range(8, 112, 8), 5):
            own[at] = fresh(1)[0]
        copy = own[:60] + fresh(1) + own[61:]
        texts += [" ".join(own), " ".join(copy)]
    long = fresh(60_000)
    texts += [" ".join(long), " ".join([*long[:30_000], "x", *long[30_001:]]), " ".join(fresh(60_000))]
    got = {r.doc_id: r.class_id for r in nd.classes(docs_of(texts)).collect()}
    assert sorted((d, c, sum(v == c for v in got.values())) for d, c in got.items()) == plain_linked(texts)


def plain_linked(texts, least=0.8):
    """Classes of texts in which no shingle repeats, where the similarity is that of sets."""
    sets, parent = [set(counts_of(t)) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if abs(len(a) - len(sets[j])) < len(a) and root(i) != root(j) and len(a & sets[j]) >= least * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    roots = [root(i) for i in range(len(texts))]
    size = Counter(roots)
    return sorted((i, r, size[r]) for i, r in enumerate(roots))
