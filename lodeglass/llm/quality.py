"""Document quality: a classifier's evidence under priors of sites and their sections, shrunk by empirical Bayes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from lodeglass.llm.shared import cut, words
from lodeglass.llm.toxicity import in_training

_UPPER, _LOWER, _DIGITS, _END = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in _END)


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, words and lines; those of an empty text are all zero."""
    raw = (text or "").encode("utf-8", "replace")
    w = words(text)
    if not w:
        return [0.0] * 12
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / len(raw)
    counts, lines = Counter(w), [x for x in text.split("\n") if x.strip()]
    upper, lower = share(_UPPER), share(_LOWER)
    return [
        upper / (upper + lower + 1e-9), share(_MARKS), raw.count(b"!") / len(w), raw.count(b"|") / len(w), share(_DIGITS), raw.count(b".") / len(w), raw.count(b",") / len(w),
        len(counts) / len(w), max(counts.values()) / len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(len(w))),
    ]


@arrow_udf(ArrayType(DoubleType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([features(t) for t in batch.to_pylist()], pa.list_(pa.float64()))


def _basis(x: np.ndarray) -> np.ndarray:
    """The features, and their squares, so that too much and too little of one can both tell."""
    return np.concatenate([x, x * x], 1)


def _known(labels: DataFrame) -> DataFrame:
    """doc_id and label of the documents that may be learnt from; of several labels the lowest holds."""
    return labels.filter(F.col("quality").isin(0, 1) & in_training()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(weights, centre, scale, prior log-odds) of a logistic regression on the `sample` labelled documents of smallest
    hash that may be learnt from; None if they aren't of both classes."""
    chosen = _known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", _features("text").alias("x")).groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    y, x = got["quality"].to_numpy().astype(float), np.array(got["x"].to_pylist(), float).reshape(-1, 12)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort(x.T)
    y, x = y[order], _basis(x[order])
    centre, scale, b = x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1)
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.5 * np.eye(len(b)), z.T @ (y - p) - 0.5 * b)
    return b, centre, scale, float(np.log(y.mean() / (1 - y.mean())))


def _shrunk(parent: Column, n: str = "n", good: str = "good", strength: str = "strength", own: Column | None = None) -> Column:
    """The rate of a group drawn towards `parent` by `strength` pseudo-documents; without the document `own`, if one is given."""
    rest, fewer = (F.col(good), F.col(n)) if own is None else (F.greatest(F.col(good) - own, F.lit(0.0)), F.col(n) - 1)
    return (rest + F.col(strength) * parent) / (fewer + F.col(strength))


def _strength(groups: DataFrame, parent: str) -> DataFrame:
    """One row: how many documents' worth the parent's rate is to its groups, by moments: the less groups differ beyond
    what their sizes explain, the more. Between 1 and 10,000."""
    p, n = F.col(parent), F.col("n")
    spread = F.sum(n * (F.col("good") / n - p) ** 2) / F.sum(n)
    noise = F.sum(p * (1 - p)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return groups.agg(F.coalesce(F.least(F.greatest(F.avg(p * (1 - p)) / between - 1, F.lit(1.0)), F.lit(10_000.0)), F.lit(1.0)).alias("strength"))


def with_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 20_000) -> DataFrame:
    """doc_id, evidence (the classifier's log-odds beyond its prior), host_rate, path_rate and score of every row.

    The classifier reads the whole text alone. A document is good by its label where it has one that may be learnt
    from, else by the classifier's probability; that is summed over all documents by host and by path within it. A
    host's rate is shrunk towards the global one, a path's towards its host's, by strengths that the spread of the
    groups' own rates gives (empirical Bayes, by moments). A document's score is its evidence under its path's rate as
    prior, so that pages of sparse sites are judged as the corpus at large, and those of well-known ones by these. A
    document itself, its label included, is left out of the rates that are its own prior.

    Null hosts and paths are groups of their own; rows repeated under a doc_id count as often as they occur; a null
    doc_id has no label. Without labels of both classes there is no evidence. An empty table gives no rows. Texts of any
    length are read whole, once.
    """
    model = train(docs, labels, sample)

    @arrow_udf("double")
    def log_odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([features(t) for t in batch.to_pylist()]).reshape(-1, 12)
            z = np.c_[np.ones(len(x)), (_basis(x) - model[1]) / model[2]] @ model[0] if model else np.zeros(len(x))
            yield pa.array(np.clip(z, -12, 12))

    rated = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), log_odds("text").alias("odds"))
    rows = cut(rated.join(_known(labels), "doc_id", "left").withColumn("own", F.coalesce("quality", 1 / (1 + F.exp(-F.col("odds"))))))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), (F.sum("good") / F.sum("n")).alias("rate"))
    hosts = hosts.crossJoin(F.broadcast(whole))
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "rate"))).withColumn("shrunk", _shrunk(F.col("rate")))
    hosts = hosts.select(F.col("host").alias("of_host"), "all_n", "all_good", F.col("n").alias("host_n"), F.col("good").alias("host_good"), F.col("strength").alias("host_strength"), "shrunk")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    paths = paths.crossJoin(F.broadcast(_strength(paths, "shrunk"))).withColumnsRenamed({"path": "of_path"}).drop("host", "shrunk")
    known = rows.join(paths, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))

    own, prior = F.col("own"), F.lit(model[3] if model else 0.0)
    top = (F.greatest(F.col("all_good") - own, F.lit(0.0)) + 0.5) / F.col("all_n")
    host_rate = _shrunk(top, "host_n", "host_good", "host_strength", own)
    rated = known.withColumn("host_rate", host_rate).withColumn("path_rate", _shrunk(F.col("host_rate"), own=own)).withColumn("evidence", F.col("odds") - prior)
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    return rated.select("doc_id", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))).alias("score"))
