import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np

from lodeglass.llm import toxicity
from lodeglass.llm.shared import words

INSULTS = ["clod", "oafish", "dunce"]


def corpus(n=240):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("abeilnorst"), rng.integers(2, 7))) for _ in range(120)]
    texts, labels = [], []
    for i in range(n):
        w = [str(x) for x in rng.choice(plain, rng.integers(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), INSULTS[int(rng.integers(3))])
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    return texts, labels


def test_held_out_accuracy(spark, docs_of):
    texts, labels = corpus()
    got = toxicity.with_toxicity(docs_of(texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(r.toxicity >= 0.7) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.toxicity <= 1 for r in got)


def test_labels_of_the_held_out_are_never_used(spark, docs_of):
    texts, labels = corpus(120)
    docs = docs_of(texts)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.with_toxicity(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).select("doc_id", "toxicity").orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def brute(labelled, word):
    """Interpolated Kneser-Ney of one word's characters, with counts in dictionaries."""
    grams = [Counter(), Counter()]
    suffixes = set()
    for text, y in labelled:
        for w in words(text):
            s = f" {w.decode()} "
            for i in range(1, len(s)):
                g = s[max(0, i + 1 - toxicity.ORDER) : i + 1]
                grams[y][g] += 1
                suffixes |= {g[k:] for k in range(len(g) - 1)}
    low = Counter(x[1:] for x in suffixes)
    context, kinds = Counter(), Counter()
    for u, n in low.items():
        context[u[:-1]] += n
        kinds[u[:-1]] += 1
    total, types = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for y in (0, 1):
        for g, n in grams[y].items():
            total[y][g[:-1]] += n
            types[y][g[:-1]] += 1
    d, out = toxicity.DISCOUNT, [0.0, 0.0]
    clip = lambda x: min(1, max(1e-3, x))
    s = f" {word} "
    for i in range(1, len(s)):
        g = s[max(0, i + 1 - toxicity.ORDER) : i + 1]
        p = 0.99 * low[g[-1]] / context[""] + 0.01 / 256
        for k in range(2, len(g)):
            u = g[-k:]
            if context[u[:-1]]:
                p = max(low[u] - d, 0) / context[u[:-1]] + clip(d * kinds[u[:-1]] / context[u[:-1]]) * p
        for y in (0, 1):
            t = total[y][g[:-1]]
            out[y] += np.log(max(grams[y][g] - d, 0) / t + clip(d * types[y][g[:-1]] / t) * p if t else p)
    return out[1] - out[0]


def test_ratios_equal_brute_force(spark, docs_of):
    texts, labels = corpus(40)
    texts[0] += " naïve ça 12"
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.train(docs_of(texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    labelled = [(texts[i], labels[i][2]) for i in ids]
    for w in ["clod", "dunce", "ab", "a", "naïve", "zzz", "clodab", *texts[3].split()[:10]]:
        assert np.isclose(model.word_ratios([w.encode()])[0], brute(labelled, w), atol=1e-3), w


def test_tables_keep_every_key():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 1_500_000).astype(np.uint64) * np.uint64(2))
    table = toxicity.Table(keys[::-1], np.arange(1, len(keys) + 1, dtype=float)[::-1, None])
    assert (table(keys)[:, 0] == np.arange(1, len(keys) + 1)).all() and not table(keys + np.uint64(1)).any()
    again = pickle.loads(pickle.dumps(table))
    assert (again(keys[:1000]) == table(keys[:1000])).all() and again.begins.size >= len(keys)
    none = toxicity.Table(np.zeros(0, np.uint64), np.zeros((0, 2)))
    assert none(keys[:5]).shape == (5, 2) and not none(keys[:5]).any()
    few = toxicity.Table(np.array([5, 1, 3], np.uint64), np.array([[5.0], [1.0], [3.0]]))
    assert few(np.arange(8, dtype=np.uint64))[:, 0].tolist() == [0, 1, 0, 3, 0, 5, 0, 0]


def test_counts_of_large_corpora_are_exact(spark, docs_of):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 6)) for _ in range(4000)) for _ in range(24)]
    model = toxicity.train(docs_of(texts), spark.createDataFrame([(i, 1, i % 2) for i in range(24)], "doc_id bigint, quality int, toxic int"))
    labelled = [(t, i % 2) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1]
    for w in [labelled[0][0].split()[0], labelled[1][0].split()[9]]:
        assert np.isclose(model.word_ratios([w.encode()])[0], brute(labelled, w), atol=1e-3), w


def test_odd_tables(spark, docs_of):
    texts, labels = corpus(60)
    many = [*texts, None, "", "?!", "clod " * 20_000]
    got = toxicity.with_toxicity(docs_of(many), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (4, 1, 1), (4, 0, 1)], "doc_id bigint, quality int, toxic int")).collect()
    score = {r.doc_id: r.toxicity for r in got}
    assert len(got) == 64 and score[60] == score[61] == score[62] < 0.7 < score[63]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.toxicity for r in toxicity.with_toxicity(docs_of(texts), none).collect()} == {0.0}
    assert toxicity.with_toxicity(docs_of([]), none).collect() == []
