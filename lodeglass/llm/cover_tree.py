"""Exact top-k inner products by dual traversal of cover trees over queries and data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.llm.shared import cut

#: A node of at most so many vectors isn't split; so many of them, drawn by a hash, give the first level's centres; so many
#: data blocks, about, are searched for a query block in one task.
LEAF, PIVOT_SAMPLE, SEARCHED = 16, 4096, 256
#: A score below and an id above all others.
NOTHING, NOBODY = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


@dataclass
class Tree:
    """A cover tree's nodes, numbered by breadth from the root, 0. Node i's rows (places of vectors) are the `size[i]` ones from
    `rows[start[i]]` on, its centre first, all within `radius[i]` of it; its children are the nodes `first[i]` to `first[i + 1]`."""

    rows: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    radius: np.ndarray

    def node(self, i: int) -> Node:
        run = self.rows[self.start[i] : self.start[i] + self.size[i]]
        return Node(int(run[0]), float(self.radius[i]), run, range(self.first[i], self.first[i + 1]), self)

    def pack(self) -> tuple[bytes, bytes]:
        """The nodes as bytes, for vectors that are stored in the order of `rows`."""
        return np.stack([self.start, self.size, self.first[1:]]).astype("<i4").tobytes(), self.radius.astype("<f8").tobytes()

    @classmethod
    def unpack(cls, nodes: bytes, radii: bytes) -> Tree:
        start, size, last = np.frombuffer(nodes, "<i4").reshape(3, -1)
        return cls(np.arange(size[0]), start, size, np.r_[1, last], np.frombuffer(radii, "<f8"))


@dataclass
class Node:
    """Vectors of a block, given by their places (`rows`), within `radius` of the one at `centre`; its children's numbers in a tree.

    One without children is a leaf, or rows of several leaves, kept together so that they meet what they meet at once.
    """

    centre: int
    radius: float
    rows: np.ndarray
    children: range = range(0)
    tree: Tree | None = None

    def _of(self, what: np.ndarray) -> np.ndarray:
        return what[self.children.start : self.children.stop]

    @property
    def heads(self) -> np.ndarray:
        """The children's centres."""
        return self.tree.rows[self._of(self.tree.start)]

    @property
    def radii(self) -> np.ndarray:
        return self._of(self.tree.radius)

    @property
    def sizes(self) -> np.ndarray:
        return self._of(self.tree.size)

    def child(self, i: int) -> Node:
        return self.tree.node(self.children[i])

    def split(self, places: np.ndarray, tops: np.ndarray) -> list[tuple[float, Node]]:
        """The children at these places with their bounds, highest last, and after them all rows of leaves in one."""
        places = places[np.argsort(tops[places], kind="stable")]
        numbers = places + self.children.start
        leaf = self.tree.first[numbers] == self.tree.first[numbers + 1]
        out = [(float(tops[i]), self.child(i)) for i in places[~leaf]]
        if leaf.any():
            start, size = self.tree.start[numbers[leaf]], self.tree.size[numbers[leaf]]
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((float(tops[places[leaf]].max()), Node(self.centre, self.radius, self.tree.rows[at])))
        return out


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most so many different vectors, chosen farthest-first."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2.0 * (x @ centres.T)).argmin(1)


def build(x: np.ndarray) -> Node:
    """The root of a cover tree: children cover their node's vectors within half its radius (covering), and their centres, the
    node's own among them, lie farther apart than that (separation); there are as many of them as this takes."""
    apart = (x @ x.T).astype(np.float64)
    squares = apart.diagonal().copy()
    apart *= -2
    apart += squares
    apart += squares[:, None]
    np.sqrt(np.maximum(apart, 0, out=apart), out=apart)

    rows, root = np.arange(len(x)), int(((x - x.mean(0)) ** 2).sum(1).argmin())
    rows[[0, root]] = root, 0
    start, size, first, radius, i = [0], [len(x)], [1], [float(apart[root].max())], 0
    while i < len(start):
        if size[i] > LEAF and radius[i] > 0:
            run = rows[start[i] : start[i] + size[i]]
            far, heads, owner = apart[run[0]][run], [0], np.zeros(size[i], np.int64)
            while far[k := int(far.argmax())] > radius[i] / 2:
                near = apart[run[k]][run]
                owner[near < far] = len(heads)
                np.minimum(far, near, out=far)
                heads.append(k)
            place = 2 * owner + 1
            place[heads] -= 1
            order, held = np.argsort(place, kind="stable"), np.bincount(owner)
            begins = np.cumsum(held) - held
            start += (start[i] + begins).tolist()
            size += held.tolist()
            radius += np.maximum.reduceat(far[order], begins).tolist()
            run[:] = run[order]
        first.append(len(start))
        i += 1
    return Tree(rows, np.array(start), np.array(size), np.array(first), np.array(radius)).node(0)


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((queries, k), NOTHING), np.full((queries, k), NOBODY)

    @property
    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Candidates `ids` with a row of scores for each query in `rows`; a query's own id doesn't count."""
        low, k = self.worst[rows], self.k
        good = scores >= low.astype(scores.dtype)[:, None]
        if len(ids) > 2 * k and np.count_nonzero(good) > 2 * k * len(rows):
            rest = np.where(ids == own[rows][:, None], scores.dtype.type(NOTHING), scores)
            good &= scores >= np.partition(rest, len(ids) - k, axis=1)[:, len(ids) - k, None]
        q, c = np.nonzero(good)
        s, d = scores[q, c].astype(np.int64), ids[c]
        new = (d != own[rows[q]]) & ((s > low[q]) | (d < self.ids[rows[q], -1]))
        if not new.any():
            return
        met, who = np.unique(q[new], return_inverse=True)
        rows, who = rows[met], np.concatenate([np.repeat(np.arange(len(met)), k), who])
        s, d = np.concatenate([self.scores[rows].ravel(), s[new]]), np.concatenate([self.ids[rows].ravel(), d[new]])
        order = np.lexsort((d, -s, who))
        order = order[np.searchsorted(who[order], np.arange(len(met)))[:, None] + np.arange(k)]
        self.scores[rows], self.ids[rows] = s[order], d[order]


def bound(a: np.ndarray, ra, b: np.ndarray, rb):
    """No inner product of a vector within `ra` of `a` and one within `rb` of `b` is higher; for one pair, or a row of centres `a` or `b` and their radii."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot = a @ b if a.ndim >= b.ndim else b @ a
    return dot + ra * np.sqrt((b * b).sum(-1)) + rb * np.sqrt((a * a).sum(-1)) + ra * rb + 1e-6 * (1 + np.abs(dot))


def dual(q: np.ndarray, own: np.ndarray, qtree: Node, x: np.ndarray, ids: np.ndarray, xtree: Node, best: Best) -> int:
    """Offers to every query all data that may belong to its best; node pairs that can't beat the group's worst kth score are pruned.

    The node of larger radius is split first, and its leaves go on together. Queries in leaves have a bound each, and meet a
    data node's children at once: with children of one vector that gives the scores. Returns how many scores of a query and a
    vector were offered.
    """
    lengths, stack, offered = np.sqrt((q.astype(np.float64) ** 2).sum(1)), [(np.inf, qtree, xtree)], 0
    while stack:
        top, a, b = stack.pop()
        if top < best.worst[a.rows].min():
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            tops = bound(q[a.heads], a.radii, x[b.centre], b.radius)
            stack += [(t, part, b) for t, part in a.split(np.arange(len(tops)), tops)]
            continue
        if a.children:
            tops = bound(x[b.heads], b.radii, q[a.centre], a.radius)
            stack += [(t, a, part) for t, part in b.split(np.flatnonzero(tops >= best.worst[a.rows].min()), tops)]
            continue
        rows = a.rows[bound(q[a.rows], 0.0, x[b.centre], b.radius) >= best.worst[a.rows]]
        if not len(rows):
            continue
        if not b.children:
            best.offer(rows, q[rows] @ x[b.rows].T, ids[b.rows], own)
            offered += len(rows) * len(b.rows)
            continue
        heads, one = b.heads, b.sizes == 1
        dots = q[rows] @ x[heads].T
        if one.any():
            best.offer(rows, dots if one.all() else dots[:, one], ids[heads[one]], own)
            offered += len(rows) * int(one.sum())
        if not one.all():
            each = np.full(dots.shape, -np.inf)
            each[:, ~one] = dots[:, ~one] + lengths[rows][:, None] * b.radii[~one] + 1e-6 * (1 + np.abs(dots[:, ~one]))
            alive = np.flatnonzero((each >= best.worst[rows][:, None]).any(0))
            stack += [(t, Node(a.centre, a.radius, rows), part) for t, part in b.split(alive, each.max(0))]
    return offered


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v, floor(64 * x) of each component x as a double; vectors that are null or hold nulls or non-finite numbers are left out."""
    x = F.col(vector_column).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(fine & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.transform(x, lambda c: F.floor(c * 64).cast("double")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, with zeros for components that shorter ones lack."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, out = lists.flatten().to_numpy(zero_copy_only=False), np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


_BLOCK = "pivot bigint, block bigint, id array<bigint>, v binary, centre array<double>, radius double, reach double, nodes binary, radii binary"


def blocks(rows: DataFrame, pivots: np.ndarray, most: int, dtype: str, exact: str) -> DataFrame:
    """Blocks of about `most` vectors at most that have the same nearest pivot: pivot, a key, ids, vectors as integers of
    the given type, their centre and covering radius, how far from the pivot they reach, and their cover tree, built once
    here, in whose order ids and vectors are; distances come from inner products of type `exact`.

    A pivot with many vectors, copies of one included, is spread over as many blocks as it needs by a hash of the id,
    so no task gathers all of it.
    """
    width = pivots.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"], width)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary()), pa.array(nearest(x, shared.value), pa.int64())], names=["id", "v", "pivot"])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        payload, pivot = b"".join(table["v"].to_pylist()), key[0].as_py()
        packed = np.frombuffer(payload, dtype).reshape(-1, width)
        x, tree = packed.astype(np.float64), build(packed.astype(exact)).tree
        centre, far = x.mean(0), lambda c: float(np.sqrt(((x - c) ** 2).sum(1).max()))
        nodes, radii = tree.pack()
        return pa.table({
            "pivot": [pivot], "block": [pivot << 32 | key[1].as_py()], "id": pa.array([table["id"].to_numpy()[tree.rows]], pa.list_(pa.int64())), "v": pa.array([packed[tree.rows].tobytes()], pa.binary()),
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [far(centre)], "reach": [far(shared.value[pivot])],
            "nodes": pa.array([nodes], pa.binary()), "radii": pa.array([radii], pa.binary()),
        })

    found = rows.mapInArrow(near, "id bigint, v binary, pivot bigint")
    sizes = found.groupBy("pivot").agg(F.count("*").alias("n"))
    dealt = found.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(most))))
    return cut(dealt.groupBy("pivot", "part").applyInArrow(gather, _BLOCK))


def top_k(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = 32, block: int = 2048, query_block: int = 2048) -> DataFrame:
    """The k candidates of highest inner product for each query, over components floor(64 * x), ties to smaller ids.

    Queries and data are indexed together. The first level of both trees is at most `pivots` vectors, spread over a
    bounded sample of PIVOT_SAMPLE; every vector goes to its nearest one, and a pivot's vectors to blocks of bounded
    size with centres and covering radii. Node pairs are pruned by their bounds on three levels: pivots against pivots;
    the blocks of what is left, found by joins on the pivots' numbers; and, in tasks that each hold one query block and
    meet the data blocks it still needs, best bound first, the cover trees of both blocks. On the first two levels a
    bound must reach the kth best score that the query's group is sure of: nodes whose lowest possible inner products
    are highest, until they hold k vectors. In the trees it must reach the group's worst kth score so far. A task meets
    about SEARCHED data blocks, so that no query block's search grows with the data; each keeps the k best of its
    part, and these are merged. A data block's vectors go to each query block (up to `query_block` queries of a pivot)
    that needs them, as small integers. Results are exact.

    is_query makes a condition of the id column. Vectors that are null or hold nulls or non-finite components take no
    part, nor do null ids; shorter vectors count as zero where they end. Rows repeated under one id are candidates as
    often, and no row answers a query of its own id. Returns query_id, rank (from 1), vec_id, score; nothing for an
    empty table.
    """
    rows, schema = quantised(vectors, id_column, vector_column), "query_id bigint, rank int, vec_id bigint, score bigint"
    width, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()
    repeats = rows.groupBy("id").count().agg(F.max("count")).first()[0]
    width, dtype = max(width, 1), next((d for d, top in (("<i1", 127), ("<i2", 32767)) if (most or 0) <= top), "<f8")
    exact = next((t for t, top in (("<f4", 2**24), ("<f8", 2**53)) if (most or 0) ** 2 * width < top), "<i8")
    drawn = _matrix(sample["v"].combine_chunks(), width)
    centres = drawn[net(drawn, pivots)]
    data, asked = blocks(rows, centres, block, dtype, exact), blocks(rows.filter(is_query(F.col("id"))), centres, query_block, dtype, exact)
    heads, heads_q = (x.select("pivot", "block", "centre", "radius", "reach", F.size("id").alias("n")) for x in (data, asked))

    reach, reach_q = ({r.pivot: (r.reach, r.n) for r in h.groupBy("pivot").agg(F.max("reach").alias("reach"), F.sum("n").alias("n")).collect()} for h in (heads, heads_q))
    kept = []
    for a, (ra, _) in reach_q.items():
        spans = sorted((bound(-centres[a], ra, centres[b], rb), bound(centres[a], ra, centres[b], rb), b, n) for b, (rb, n) in reach.items())
        held = np.cumsum([x[3] for x in spans])
        sure = next((-low for (low, *_), n in zip(spans, held, strict=True) if n >= k + repeats), -np.inf)
        kept += [(a, b) for _, top, b, _ in spans if top >= sure]

    near = F.broadcast(vectors.sparkSession.createDataFrame(kept, "qp bigint, dp bigint"))
    q, d = heads_q.selectExpr("pivot as qp", "block as q", "centre as qc", "radius as qr"), heads.selectExpr("pivot as dp", "block as d", "centre as dc", "radius as dr", "n")
    dot = F.aggregate(F.zip_with("qc", "dc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    slack = F.col("qr") * norm("dc") + F.col("dr") * norm("qc") + F.col("qr") * F.col("dr") + 1e-6 * (1 + F.abs(dot))
    pairs = q.join(near, "qp").join(d, "dp").select("q", "d", "n", (dot + slack).alias("top"), (dot - slack).alias("floor"))
    best_first = Window.partitionBy("q").orderBy(F.desc("floor"), "d").rowsBetween(Window.unboundedPreceding, 0)
    sure = pairs.withColumn("held", F.sum("n").over(best_first)).withColumn("sure", F.max(F.when(F.col("held") >= k + repeats, F.col("floor"))).over(Window.partitionBy("q")))
    wanted = sure.filter(F.col("sure").isNull() | (F.col("top") >= F.col("sure"))).select("q", "d", "top")
    return _search(wanted, data, asked, width, dtype, exact, k, schema)


def _search(wanted: DataFrame, data: DataFrame, asked: DataFrame, width: int, dtype: str, exact: str, k: int, schema: str) -> DataFrame:
    """The pairs searched: each query block meets its data blocks in tasks of about SEARCHED of them, one after another, and the k best of all its parts remain."""
    names = ["q", "part", "d", "top", "id", "v", "nodes", "radii"]
    parts = wanted.groupBy("q").agg(F.ceil(F.count("*") / F.lit(SEARCHED)).alias("parts"))
    sent = wanted.join(parts, "q").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts"))).join(data.select(F.col("block").alias("d"), "id", "v", "nodes", "radii"), "d").select(names)
    own = asked.withColumnRenamed("block", "q").join(parts, "q").select("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("d"), F.lit(float("inf")).alias("top"), "id", "v", "nodes", "radii")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close() -> pa.RecordBatch:
            _, ids, _, best = state
            found = best.ids != NOBODY
            row = np.nonzero(found)[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), now[0])), pa.array(row), pa.array(ids[row]), pa.array(best.ids[found]), pa.array(best.scores[found])], names=["q", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, ids = (batch["q"][i].as_py(), batch["part"][i].as_py()), batch["id"][i].values.to_numpy()
                if key == now and batch["top"][i].as_py() < state[3].worst.min():
                    continue
                x = np.frombuffer(batch["v"][i].as_buffer(), dtype).reshape(-1, width).astype(exact)
                root = Tree.unpack(batch["nodes"][i].as_buffer(), batch["radii"][i].as_buffer()).node(0)
                if key == now:
                    dual(state[0], state[1], state[2], x, ids, root, state[3])
                    continue
                if state:
                    yield close()
                now, state = key, (x, ids, root, Best(len(ids), k))
        if state:
            yield close()

    dealt = own.select(names).unionByName(sent).repartition("q", "part").sortWithinPartitions("q", "part", F.desc("top"), "d")
    found = dealt.mapInArrow(search, "q bigint, row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q", "row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
