import zlib

import numpy as np
from pyspark.sql import functions as F

from lodeglass.llm import quality


def corpus(n=300):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abeilnorst"), rng.integers(2, 7))) for _ in range(80)]
    texts, labels = [], []
    for i in range(n):
        w = [str(x) for x in rng.choice(vocabulary, rng.integers(20, 60))]
        bad = i % 5 == 0
        texts.append([" ".join(w).upper() + "!!", " | ".join(w), " ".join([w[0]] * 30)][i // 5 % 3] if bad else ", ".join(w).capitalize() + ".")
        labels.append((i, int(not bad), 0))
    return texts, labels


SCHEMA = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark, docs_of):
    texts, labels = corpus()
    got = quality.with_quality(docs_of(texts), spark.createDataFrame(labels, SCHEMA), F.col("source"), F.col("lang")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == 300 and np.mean([(r.score >= 0.5) == (r.doc_id % 5 != 0) for r in held]) > 0.95


def plain_rates(rows):
    """(host_rate, path_rate) of (host, path, good) rows, each left out of its own groups."""
    def groups(key):
        out = {}
        for r in rows:
            n, good = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, good + r[2])
        return out

    def strength(found, parent):
        total = sum(n for n, _ in found.values())
        spread = sum(n * (good / n - parent(k)) ** 2 for k, (n, good) in found.items()) / total
        noise = sum(parent(k) * (1 - parent(k)) for k in found) / total
        mean = sum(parent(k) * (1 - parent(k)) for k in found) / len(found)
        return min(max(mean / max(spread - noise, 1e-9) - 1, 1.0), 10_000.0)

    hosts, paths, n, good = groups(lambda r: r[0]), groups(lambda r: r[:2]), len(rows), sum(r[2] for r in rows)
    s = strength(hosts, lambda k: good / n)
    shrunk = {k: (g + s * good / n) / (m + s) for k, (m, g) in hosts.items()}
    t = strength(paths, lambda k: shrunk[k[0]])
    out = []
    for host, path, own in rows:
        top = (good - own + 0.5) / n
        h = (hosts[host][1] - own + s * top) / (hosts[host][0] - 1 + s)
        out.append((h, (paths[host, path][1] - own + t * h) / (paths[host, path][0] - 1 + t)))
    return out


def test_rates_equal_brute_force(spark, docs_of):
    texts, labels = corpus()
    docs, known = docs_of(texts), spark.createDataFrame(labels, SCHEMA)
    host = F.when(F.col("doc_id") % 5 == 0, "bad").when(F.col("doc_id") == 1, "tiny").when(F.col("doc_id") % 7 > 0, "good")
    path = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3)
    got = {r.doc_id: r for r in quality.with_quality(docs, known, host, path).collect()}
    w, centre, scale, prior = quality.train(docs, known)
    x = np.array([quality.features(t) for t in texts])
    odds = np.clip(np.c_[np.ones(len(x)), (np.c_[x, x * x] - centre) / scale] @ w, -12, 12)
    rows = []
    for i in range(len(texts)):
        own = float(labels[i][1]) if zlib.crc32(str(i).encode()) % 3 != 1 else 1 / (1 + np.exp(-odds[i]))
        rows.append(("bad" if i % 5 == 0 else "tiny" if i == 1 else "good" if i % 7 > 0 else None, i % 3 or None, own))
    for i, (h, p) in enumerate(plain_rates(rows)):
        r = got[i]
        assert np.isclose(r.host_rate, h) and np.isclose(r.path_rate, p) and np.isclose(r.evidence, odds[i] - prior)
        assert np.isclose(r.score, 1 / (1 + np.exp(-(odds[i] - prior + np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))))))
    assert got[0].path_rate < 0.2 < 0.8 < got[2].path_rate and 0.3 < got[1].path_rate < 1


def test_odd_tables(spark, docs_of):
    texts, labels = corpus(60)
    docs = docs_of([*texts, None, "", "?!", "word " * 50_000, texts[1], texts[1]], ids=[*range(63), None, 64, 64])
    for known in ([*labels, (None, 1, 1), (3, None, 1), (4, 7, 1)], []):
        got = quality.with_quality(docs, spark.createDataFrame(known, SCHEMA), F.when(F.col("doc_id") > 9, F.col("source")), F.col("lang")).collect()
        assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    assert {round(r.evidence, 6) for r in got} == {0.0} and all(0.4 < r.score < 0.6 for r in got)
    odd = docs.selectExpr("*", "1 as odds", "2 as own", "3 as host", "4 as quality", "5 as n")
    assert len(quality.with_quality(odd, spark.createDataFrame(labels, SCHEMA), F.col("source"), F.col("host")).collect()) == 66
    assert quality.with_quality(docs_of([]), spark.createDataFrame(labels, SCHEMA), F.col("source"), F.col("lang")).collect() == []
