"""Near-duplicate classes by ProbMinHash signatures of weighted shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.llm.shared import WordHasher, cut, mix, quoted, spare, words

#: Words to a shingle; a signature's components, and how they are dealt out to bands: 25 of 5, so that a pair of
#: similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99999, and one of 0.4 with 0.23.
SHINGLE, COMPONENTS, BANDS, ROWS, SKETCH = 5, 128, 25, 5, 4 * 128

_MULTIPLIER, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; of fewer words, but not none, one of them all."""
    n, size = len(hashes), min(SHINGLE, len(hashes))
    out = np.full(n - size + 1 if n else 0, np.uint64(size), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _MULTIPLIER + hashes[k : n - size + 1 + k]
    return mix(out)


def signatures(documents: list[np.ndarray]) -> np.ndarray:
    """ProbMinHash signatures, one row of COMPONENTS for each array of shingle hashes (repeated as often as they occur).

    An element of weight w arrives at the points of a Poisson process of rate w, each at a random component; a component
    keeps the element that arrives first. So two documents agree in a component with the probability Jaccard similarity
    of their weights. Arrivals of all elements go on in rounds, each round without those that come later than every
    component of their document has been taken.
    """
    doc, h, w = [], [], []
    for d, s in enumerate(documents):
        u, n = np.unique(s, return_counts=True)
        doc.append(np.full(len(u), d))
        h.append(u)
        w.append(n)
    doc, h, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, h, w))
    first, taken = np.full(len(documents) * COMPONENTS, np.inf), np.zeros(len(documents) * COMPONENTS, np.uint64)
    t, seed = np.zeros(len(h)), np.uint64(0)
    while len(h):
        for _ in range(max(1, min(64, 20_000 // len(h)))):
            with np.errstate(over="ignore"):
                seed += _STEP
                u = mix(h ^ seed)
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
            at = doc * COMPONENTS + (u % np.uint64(COMPONENTS)).astype(np.int64)
            np.minimum.at(first, at, t)
            mine = first[at] == t
            taken[at[mine]] = h[mine]
        last = first.reshape(-1, COMPONENTS).max(1)
        on = t < last[doc]
        doc, h, w, t = doc[on], h[on], w[on], t[on]
    return taken.reshape(-1, COMPONENTS)


def bands(taken: np.ndarray) -> np.ndarray:
    """A hash of each band's components and number."""
    parts = taken[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * _MULTIPLIER + parts[:, :, k])
    return out.view(np.int64)


def sketches(taken: np.ndarray) -> np.ndarray:
    """Four bits of a hash of each component, as SKETCH / 64 numbers of 64 bits."""
    nibbles = (mix(taken) & np.uint64(15)).reshape(-1, COMPONENTS // 16, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two documents' shingle counts, exactly: the sum over common elements i of
    1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    return similarity_of(*np.unique(a, return_counts=True), *np.unique(b, return_counts=True))


def similarity_of(ua: np.ndarray, na: np.ndarray, ub: np.ndarray, nb: np.ndarray) -> float:
    """The same of distinct elements and their counts."""
    if not len(ua) or not len(ub):
        return 0.0
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = na[ia].astype(float), nb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    left = np.searchsorted(ratio, ratio, side="left")
    below, above = np.concatenate([[0.0], np.cumsum(y)])[left], x.sum() - np.concatenate([[0.0], np.cumsum(x)])[left]
    return float((1 / ((above + na.sum() - x.sum()) / x + (below + nb.sum() - y.sum()) / y)).sum())


def text_key(text: str | None, found: list[bytes]) -> bytes | None:
    """What texts of the same words share, or where there are none the same characters; None for empty ones."""
    import xxhash

    return xxhash.xxh3_128_digest(b"w " + b" ".join(found)) if found else xxhash.xxh3_128_digest(b"t " + text.encode()) if text else None


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (a 16-byte key of the text's words), bands and sketch of every row; no node for empty texts, no bands without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for low in range(0, whole.num_rows, 400):
                batch = whole.slice(low, 400)
                texts = batch["text"].to_pylist()
                split = [words(t) for t in texts]
                some = [i for i, w in enumerate(split) if w]
                taken = signatures([shingles(hasher(split[i])) for i in some])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["text_hash"], pa.array(list(map(text_key, texts, split)), pa.binary()), _lists(bands(taken), some, len(texts)), _lists(sketches(taken), some, len(texts))],
                    names=["doc_id", "text_hash", "node", "bands", "sketch"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, node binary, bands array<bigint>, sketch array<bigint>")


def _lists(rows: np.ndarray, some: list[int], n: int) -> pa.Array:
    """A list for each of n documents: the rows of `some`, in order, and empty ones."""
    sizes = np.zeros(n + 1, np.int32)
    sizes[np.array(some, int) + 1] = rows.shape[1]
    return pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), pa.array(rows.reshape(-1)))


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node that it is connected with, for every node of the edges (a, b).

    Large-star and small-star steps by turns: every node links its greater neighbours, then its lesser ones and itself,
    to the least it knows, until nothing changes. Each step is one shuffle and a window over a node's edges, which Spark
    spills and never holds as one row; no step makes more edges than it gets, and each round is cut off in the shared folder.
    """
    of = Window.partitionBy("u")
    least = F.least("u", F.min("v").over(of))

    now, before = cut(edges.select("a", "b").filter("a <> b")), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = both.withColumn("m", least).filter("v > u and v <> m")
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        seen = down.withColumns({"m": least, "last": F.lag("v").over(of.orderBy("v"))}).filter("last is null or v <> last")
        # the first edge of a node links itself, the others what they lead to
        now = cut(seen.select(F.when(F.col("last").isNull(), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are at least so similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = WordHasher(), (None, None)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if a != last[0]:
                    last = (a, shingles(hasher(words(ta))))
                keep.append(similarity(last[1], shingles(hasher(words(tb)))) >= least)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.selectExpr("node as b", "text as tb"), "b").join(texts.selectExpr("node as a", "text as ta"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _split(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of buckets in which components differ, each with its own (comp) and its bucket's largest one (main)."""
    split = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = split.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return cut(split.join(cut(mixed.select("bucket", "main")), "bucket"))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): in each bucket the member that meets most others over all bands with every other member."""
    rows = members.withColumn("met", F.sum("n").over(Window.partitionBy("node")))
    centres = cut(rows.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("a")))
    return members.join(centres, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def links(nodes: DataFrame, texts_of, least: float, deviations: float = 4) -> DataFrame:
    """node and comp of the nodes that have links: what is connected by pairs of nodes that are at least so similar.

    Nodes that share a band are candidates. In each band's bucket the node that meets most others over all bands is the
    centre, and every other node is compared with it alone; copies of one text make one component that way, at a cost in
    proportion to their number. Then only pairs of one bucket whose components still differ are left (`_rest`). All of
    these are compared, but those whose sketches (four bits of each component) lie farther apart than so many deviations
    allow for a similarity of `least`; with infinitely many, none is passed over.
    """
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(spread.join(shared, "bucket"))
    texts = cut(texts_of(members.select("node").distinct()))
    comps = components(_verified(_stars(members), texts, least))
    found = _rest(_split(members, comps), nodes.join(texts, "node"), least, _farthest(least, deviations))
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found))


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it; keys are 64-bit integers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys], 1)
        if held and any(held[0][k][0].as_py() != v for k, v in zip(keys, now[0].tolist(), strict=True)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        edges = [0, *(np.flatnonzero((now[1:] != now[:-1]).any(1)) + 1).tolist(), len(now)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(low, high - low))
            if high < len(now):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rest(mixed: DataFrame, known: DataFrame, least: float, limit: int, most: int = 512, chars: int = 8_000_000) -> DataFrame:
    """Links (a, b) between members of one bucket whose components differ: bucket, band, n, node, comp, main; `known` has node, bands, sketch and text.

    Members outside the largest component of a bucket meet all members, either bucket by bucket or, where that compares
    fewer, all buckets of one largest component together, as those of a large group of near copies hold much the same
    members in every band. Such a group is dealt into square tiles of about `most` members and `chars` characters a side,
    so a text goes to as many tiles as its group has rows of them, and pairs never leave a tile. A pair is compared
    where it shares a band (by buckets: in the first one), once its sketches allow it, and unless links found before in
    the tile connect it.
    """
    sized = mixed.join(known.select("node", F.length("text").alias("chars")), "node")
    each = sized.groupBy("main", "node").agg(F.max((F.col("comp") != F.col("main")).cast("bigint")).alias("outside"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n")).otherwise(0)).alias("met"))
    # cut off, sums are shuffled for the join like any table, so Spark can split a key that holds many rows
    whole = cut(each.groupBy("main").agg((F.sum("outside") * F.count("*") <= F.sum("met")).alias("together")))
    keyed = sized.join(whole, "main").select(F.when(F.col("together"), F.xxhash64("main")).otherwise(F.col("bucket")).alias("key"), F.when(F.col("together"), -1).otherwise(F.col("band")).alias("number"), "main", "node", "comp", "chars").distinct()
    sides = keyed.groupBy("key", "number").agg(F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum("chars") / F.lit(chars))).alias("blocks"))
    rows = keyed.join(sides, ["key", "number"]).withColumns({"own": F.pmod(F.xxhash64("node"), F.col("blocks")), "other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))})
    place = lambda side, row, column: F.struct(F.lit(side).alias("side"), F.col(row).alias("lb"), F.col(column).alias("mb"))
    # every member stands on the right, those outside the largest component on the left too
    places = F.when(F.col("comp") != F.col("main"), F.array(place(1, "other", "own"), place(0, "own", "other"))).otherwise(F.array(place(1, "other", "own")))
    dealt = rows.select("key", "number", "main", "node", "comp", F.inline(places)).join(known, "node")

    def compared(table: pa.Table) -> pa.RecordBatch:
        hasher, counts, low, out = WordHasher(), {}, {}, []
        node, comp, main, number = table["node"].to_pylist(), table["comp"].to_pylist(), table["main"][0].as_py(), table["number"][0].as_py()
        text, side = table["text"], table["side"].to_numpy()
        matrix = lambda c, n: table[c].chunk(0).flatten().to_numpy().reshape(-1, n)
        sketch, band = matrix("sketch", SKETCH // 64), matrix("bands", BANDS)

        def shingled(i: int) -> tuple[np.ndarray, np.ndarray]:
            if node[i] not in counts:
                counts[node[i]] = np.unique(shingles(hasher(words(text[i].as_py()))), return_counts=True)
            return counts[node[i]]

        def root(c: bytes) -> bytes:
            while low.get(c, c) != c:
                c = low[c]
            return c

        right = np.flatnonzero(side == 1)
        right_sketch, right_band = sketch[right], band[right]
        for i in np.flatnonzero(side == 0).tolist():
            fit = np.bitwise_count((right_sketch ^ sketch[i]).view(np.uint64)).sum(1, dtype=np.int64) <= limit
            same = right_band == band[i]
            fit &= same.any(1) if number < 0 else ~same[:, :number].any(1)
            for j in right[fit].tolist():
                if comp[i] != comp[j] and (comp[j] == main or node[i] < node[j]) and (a := root(comp[i])) != (b := root(comp[j])) and similarity_of(*shingled(i), *shingled(j)) >= least:
                    low[max(a, b)] = min(a, b)
                    out.append((node[i], node[j]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key", "number", "lb", "mb"):
            if (table["side"].to_numpy() == 0).any():
                yield compared(table)

    tile = ["key", "number", "lb", "mb"]
    return dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "a binary, b binary")


def _farthest(least: float, deviations: float) -> int:
    """Bits in which sketches of texts of that similarity differ at most: half of those of differing components, and so many deviations."""
    p = 1 - least
    return int(min(SKETCH, SKETCH * p / 2 + deviations * (COMPONENTS * (4 * p * least + p)) ** 0.5))


def classes(docs: DataFrame, least: float = 0.8, deviations: float = 4) -> DataFrame:
    """The near-duplicate class of every row: doc_id, text_hash, class_id, class_text_hash and class_rows.

    Texts are compared by their words (runs of digits, letters and non-ASCII characters, A-Z lower-cased), in shingles of
    five, weighted by how often they occur; two texts are linked if their probability Jaccard similarity is at least
    `least`, and classes are what links connect. Texts of equal words are one node from the start, in one grouped
    aggregation, so copies never meet one another. Texts without words are linked to equal ones only; null and empty
    texts are linked to none. A class is named by the least (doc_id, xxhash64 of its text) in it. Texts may be of any
    length; repeated rows are of one class; an empty table gives no rows.

    A pair of similarity `least` can be missed in two ways: it shares no band (see BANDS), or it is left to the last
    step, and its sketches lie more than `deviations` farther apart than expected.
    """
    rows = cut(signed(docs))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes)

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = nodes.join(wanted, "node").select("node", "first.doc_id", "first.text_hash")
        found = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text").join(keys, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")))
        return found.select("node", "text").dropDuplicates(["node"])

    comp = links(nodes, texts_of, least, deviations)
    named = nodes.select("node", "first", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = named.groupBy("comp").agg(F.min("first").alias("class"), F.sum("n").alias("class_rows"))
    found = named.select("node", "comp").join(whole, "comp").select("node", "class", "class_rows")
    own = F.struct("doc_id", "text_hash")
    return rows.join(found, "node", "left").select(
        "doc_id", "text_hash", F.coalesce("class", own)["doc_id"].alias("class_id"), F.coalesce("class", own)["text_hash"].alias("class_text_hash"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
    )


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without near duplicates: of each class the row that names it stays, with all its columns, once.

    Rows without words stay if no equal one stays; an empty table stays empty; columns of any names are kept as they are.
    """
    names = found_id, found_hash, key, nth = spare(docs, 4)
    winners = classes(docs, least).filter("doc_id <=> class_id and text_hash <=> class_text_hash").select(F.col("doc_id").alias(found_id), F.col("text_hash").alias(found_hash)).distinct()
    # one key that is never null, so that the window can use the join's partitioning
    winners = winners.withColumn(key, F.xxhash64(found_id, found_hash))
    keyed = docs.withColumn(found_hash, F.xxhash64("text")).withColumn(key, F.xxhash64("doc_id", found_hash))
    same = (F.col("d." + key) == F.col("w." + key)) & F.col("d.doc_id").eqNullSafe(F.col("w." + found_id)) & (F.col("d." + found_hash) == F.col("w." + found_hash))
    kept = keyed.alias("d").join(winners.alias("w"), same, "left_semi")
    first = F.row_number().over(Window.partitionBy(key, "doc_id", found_hash).orderBy(F.xxhash64(*(F.col(quoted(c)).cast("string") for c in docs.columns))))
    return kept.withColumn(nth, first).filter(F.col(nth) == 1).drop(*names)
