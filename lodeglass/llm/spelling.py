"""Spelling variants of words: exact neighbours of one edit by pairs of trie nodes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodeglass.llm.shared import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: str = r"[A-Za-zÀ-ÿ]", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word and n: the distinct words of at least so many code points and occurrences.

    A word is a maximal run of letters with only A-Z lower-cased; where `every` divides the unsigned crc32 h of
    `<doc_id>:<run>`, the run's code point h % length is deleted first. A null doc_id deletes nothing. Runs are counted
    by a grouped sum with partial sums in each task, so a word of a third of all runs is no hot key.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({letters}{{{shortest},}})"), 1)).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    hashed = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.expr("left(run, int(pmod(h, length(run))))"), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _common(a: str, b: str) -> int:
    """How many letters the two begin with alike, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if a[low:k] == b[low:k] else (low, k)
    return low


def _paths(keys: Iterator[str], carried: list[int], offset: int) -> Iterator[list[int]]:
    """The numbers of the nodes of each key's prefixes, for ascending distinct keys.

    In sorted order a prefix is new exactly where it goes beyond what the key before shares. New nodes are counted from
    0; the first ones, which ranges before this one have numbered, are the carried ones, and others get the offset.
    """
    before, path, new = "", [], 0
    for key in keys:
        same = _common(before, key)
        more = range(new, new + len(key) - same)
        path = path[:same] + [carried[x] if x < len(carried) else x + offset for x in more]
        new, before = more.stop, key
        yield path


def trie_nodes(words: DataFrame, key: Column, number: str, nodes: str) -> DataFrame:
    """The rows with the place of their (distinct) key in the order of all keys, and the nodes of its prefixes in one trie of all keys.

    Keys are dealt out by ranges, sorted and held in the shared folder. Each range numbers its own nodes; only those that
    it shares with the last key before it have an earlier number. One row a range (first and last key, the last one's
    nodes, numbers of keys and nodes) comes to the driver, which sums them up into an offset and the few carried numbers
    of each range. So no prefix is shuffled, the numbers are those of one trie from 1 on (0 is its root), and a task that
    runs again gives the same ones.
    """
    dealt = cut(words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key"))
    rest = [c for c in dealt.columns if c != "key"]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, path, n = None, None, [], 0

        def keys() -> Iterator[str]:
            nonlocal first, last, n
            for batch in batches:
                for last in batch["key"].to_pylist():
                    first, n = last if first is None else first, n + 1
                    yield last

        for path in _paths(keys(), [], 0):
            pass
        if n:
            row = {"part": TaskContext.get().partitionId(), "first": first, "last": last, "path": path, "keys": n}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("path", pa.list_(pa.int64())), ("keys", pa.int64())]))

    ranges = sorted(dealt.select("key").mapInArrow(survey, "part int, first string, last string, path array<bigint>, keys bigint").collect())
    known, before, path, next_node, next_key = {}, "", [], 1, 0
    for r in ranges:
        carried = path[: _common(before, r.first)]
        offset, own = next_node - len(carried), r.path[-1] + 1 if r.path else 0  # the last key's last node is the newest
        known[r.part] = (carried, offset, next_key)
        path = [carried[x] if x < len(carried) else x + offset for x in r.path]
        next_node, next_key, before = offset + own, next_key + r["keys"], r.last
    shared = words.sparkSession.sparkContext.broadcast(known)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, offset, place = shared.value.get(TaskContext.get().partitionId(), ([], 0, 0))
        held = []

        def keys() -> Iterator[str]:
            for batch in batches:
                held.append(batch)
                yield from batch["key"].to_pylist()

        paths = _paths(keys(), carried, offset)
        for path in paths:
            batch = held.pop()
            found = [path, *(next(paths) for _ in range(batch.num_rows - 1))]
            yield pa.record_batch([*(batch[c] for c in rest), pa.array(range(place, place + len(found)), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*rest, number, nodes])
            place += batch.num_rows

    return dealt.mapInArrow(numbered, dealt.select(*rest).schema.add(number, LongType()).add(nodes, ArrayType(LongType())))


def neighbours(words: DataFrame) -> DataFrame:
    """id, word and n of distinct words, with n_near (words at one inserted, deleted or replaced letter) and best (n and negative id of the most frequent of them).

    Words get the nodes of their prefixes in a trie and of their suffixes in a reversed one. A word with a letter skipped
    is the pair (node before it, node behind it); a word with a gap for one more letter is a pair as well, at each place.
    Words of one skip pair differ by that letter, and a word with a gap is one letter short of those that skip it there.
    A letter that repeats the one before it gives the same shorter word, so only the first of a run counts as a deletion.
    Thus no two words meet twice, and all pairs are exact.

    A pair of nodes holds one word for each letter of the alphabet, and one more with a gap, at most. Their numbers, not
    their letters, are shuffled: 2 * length + 1 rows a word.
    """
    numbered = trie_nodes(trie_nodes(words, F.col("word"), "id", "heads"), F.reverse("word"), "other", "tails")
    held = numbered.withColumns({"heads": F.concat(F.array(F.lit(0).cast("bigint")), "heads"), "tails": F.concat(F.array(F.lit(0).cast("bigint")), "tails"), "letters": F.split("word", ""), "size": F.length("word")})
    skips = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(
        F.get("heads", i).alias("head"), F.get("tails", F.col("size") - i - 1).alias("tail"),
        F.when((i > 0) & (F.get("letters", i) == F.get("letters", i - 1)), 1).otherwise(2).alias("kind"),
    ))
    gaps = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: F.struct(F.get("heads", i).alias("head"), F.get("tails", F.col("size") - i).alias("tail"), F.lit(0).alias("kind")))
    rows = held.select("id", "n", F.inline(F.concat(skips, gaps)))

    pair = Window.partitionBy("head", "tail")
    ordered = pair.orderBy(F.col("kind") == 0, F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me, skipped = F.struct("n", (-F.col("id")).alias("id")), F.when(F.col("kind") > 0, F.struct("n", (-F.col("id")).alias("id")))
    met = rows.withColumns({
        "first": F.first(skipped).over(ordered), "second": F.nth_value(skipped, 2).over(ordered),
        "shorter": F.max(F.when(F.col("kind") == 0, me)).over(pair), "longer": F.max(F.when(F.col("kind") == 2, me)).over(pair),
        "n_skips": F.count_if(F.col("kind") > 0).over(pair), "n_longer": F.count_if(F.col("kind") == 2).over(pair), "n_all": F.count("*").over(pair),
    }).filter("n_all > 1")
    other = F.when(F.col("first.id") == -F.col("id"), F.col("second")).otherwise(F.col("first"))
    deletes = F.col("kind") == 2
    best = F.when(F.col("kind") == 0, F.col("longer")).otherwise(F.greatest(other, F.when(deletes, F.col("shorter"))))
    n_near = F.when(F.col("kind") == 0, F.col("n_longer")).otherwise(F.col("n_skips") - 1 + F.when(deletes, F.col("n_all") - F.col("n_skips")).otherwise(0))
    found = met.select("id", n_near.alias("n_near"), best.alias("best")).filter("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    return numbered.select("id", "word", "n").join(found, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))


def roots(links: DataFrame, rounds: int) -> DataFrame:
    """id and the last of the chain of (id, form_id) that begins there, by doubling: each round jumps as far again as all before."""
    ends = links.select("id", F.col("form_id").alias("root_id"))
    for _ in range(rounds):
        ends = cut(ends)
        further = ends.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        ends = ends.join(further, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"))
    return ends


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words with counts.

    A word's form is the most frequent word at one inserted, deleted or replaced letter (of equal ones the first in
    code-point order), if that has at least `times` times its own count; else it has none, and form and form_n are null.
    Its root is the last of the chain of forms, or the word itself. As counts double along a chain, it has at most
    log2(greatest / least count) steps, and its end is found in the logarithm of that many joins of integer pairs.

    Words are distinct and not empty; they may be of any length, as a word makes rows of integers in proportion to it. An
    empty table stays empty.
    """
    found = cut(neighbours(words.select("word", "n")))
    linked = F.col("best.n") >= times * F.col("n")
    links = found.filter(linked).select("id", (-F.col("best.id")).alias("form_id"))
    least, most = found.agg(F.min("n"), F.max("n")).first()
    steps = math.log(most / least, times) if least else 0
    ends = roots(links, math.ceil(math.log2(steps + 1)))
    names = found.select("id", "word", "n")
    forms = links.join(names.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id").join(ends, "id")
    forms = forms.join(names.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "form", "form_n", "root")
    return found.join(forms, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
