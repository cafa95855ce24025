"""Exact joins of vectors by their cosine: cells around pivots, and only pairs of blocks that the triangle inequality leaves."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeglass.operators.storage import cut
from lodeglass.operators.vectors import unit

_SLACK = 1e-6  #: of angles, as rounding moves them
_GROUP = 32 << 20  #: bytes of vectors in a group, of which a task holds one
_LINKS = "array<struct<a: bigint, b: bigint, cosine: double>>"


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of equal length, a row each."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """id, u (the unit vector) and all other columns but the embedding, of vectors that have a direction: not null, no null, infinite or undefined component, not all zero."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("u", unit(F.col("embedding"))).drop("embedding")


def pivots(rows: DataFrame, n: int, most: int = 512, rounds: int = 6) -> np.ndarray:
    """Directions of cells for n rows: spherical k-means over the 16 rows a cell of smallest hash, a bounded sample (8,192 rows at most) on the driver. Any pivots give exact joins; good ones prune more."""
    cells = max(1, min(most, int(n**0.5) // 2))
    sample = np.array([r.u for r in rows.select("id", "u").orderBy(F.xxhash64("id"), "id").limit(16 * cells).collect()], float)
    found = sample[:: max(1, len(sample) // cells)][:cells]
    for _ in range(rounds):
        of = (sample @ found.T).argmax(1)
        sums = np.array([sample[of == k].sum(0) for k in range(len(found))])
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(sizes > 1e-9, sums / np.maximum(sizes, 1e-9), found)
    return found


class Cells:
    """Vectors in cells (each with its nearest pivot) and blocks of about `block` of a cell, held in the shared folder.

    The driver holds the pivots, and each cell's radius and number of rows; a cell of any size, as of a third of all
    rows, is dealt into blocks by a hash.
    """

    def __init__(self, rows: DataFrame, found: np.ndarray, block: int = 256) -> None:
        self.spark, self.pivots, self.block = rows.sparkSession, found, block
        self.shared = self.spark.sparkContext.broadcast(found)
        self.rows = cut(self.assigned(rows))
        known = self.rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
        self.radius = np.full(len(found), -1.0)
        self.counts = np.zeros(len(found), np.int64)
        for r in known:
            self.radius[r.cell], self.counts[r.cell] = r.radius, r.n

    def assigned(self, rows: DataFrame) -> DataFrame:
        """With cell, the number of the nearest pivot, and angle, how far it is."""
        shared = self.shared

        @arrow_udf("cell int, angle double")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                near = _matrix(batch) @ shared.value.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["cell", "angle"])

        at = rows.withColumn("at", nearest("u"))
        return at.withColumns({"cell": F.col("at.cell"), "angle": F.col("at.angle")}).drop("at")

    def asked(self, rows: DataFrame, reach: Column, upwards: bool) -> DataFrame:
        """Assigned rows with `cells`, all that may hold a vector within their reach (an angle).

        A vector y of cell B lies within the reach of x only if x is no farther from B's pivot than B's radius and the
        reach together, and, as y is nearest to B's pivot, no farther from it than from its own pivot and twice the reach.
        `upwards` leaves out cells of smaller number than the row's own, as for pairs that meet once.
        """
        shared, radius = self.shared, self.radius

        @arrow_udf("array<int>")
        def needed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for u, cell, angle, reach in batches:
                far = np.arccos(np.clip(_matrix(u) @ shared.value.T, -1, 1))
                cell, angle, reach = (x.to_numpy(zero_copy_only=False) for x in (cell, angle, reach))
                keep = (far <= radius + reach[:, None] + _SLACK) & (far <= (angle + 2 * reach)[:, None] + _SLACK) & (radius >= 0)
                if upwards:
                    keep &= np.arange(len(radius)) >= cell[:, None]
                yield pa.ListArray.from_arrays(np.append(0, keep.sum(1).cumsum()).astype(np.int32), pa.array(np.nonzero(keep)[1], pa.int32()))

        return rows.withColumn("cells", needed("u", "cell", "angle", reach))

    def blocks(self, rows: DataFrame, *more: str) -> DataFrame:
        """A row for each block of a cell: members (id, u and more), and all cells that any of them asks for."""
        parts = F.array(*(F.lit(int(max(1, -(-n // self.block)))) for n in self.counts))
        block = F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell")))
        held = rows.groupBy("cell", block.alias("block"))
        wanted = [F.array_distinct(F.flatten(F.collect_set("cells"))).alias("cells")] if "cells" in rows.columns else []
        return held.agg(F.collect_list(F.struct("id", "u", *more)).alias("members"), *wanted)

    def tiles(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of blocks (members as l and r, same: whether they are one cell's) that may hold near pairs: an equal join by cell, which Spark splits where a cell has many blocks."""
        asked = left.select(F.col("cell").alias("home"), F.explode("cells").alias("cell"), F.col("members").alias("l"))
        met = asked.join(right.select("cell", F.col("members").alias("r")), "cell")
        return met.select(F.struct("l").alias("l"), F.struct("r").alias("r"), (F.col("home") == F.col("cell")).alias("same"))


def _side(side: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    members = side.field(0)[k].values
    return members.field("id").to_numpy(zero_copy_only=False), _matrix(members.field("u")), members


def _links(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    a, b, c = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in range(3))
    values = pa.StructArray.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(float))], names=["a", "b", "cosine"])
    return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(r[0]) for r in rows])).astype(np.int32), values)


class _Met:
    """What a task knows of one pair of groups: the left one's vectors, and the numbers (nodes) of all rows that have come."""

    def __init__(self) -> None:
        self.held: list[tuple] = []  # place, cells, ids, u and codes of blocks, in order of place
        self.ids = None

    def build(self, cells: int) -> None:
        """Once all blocks of the left group are there."""
        self.places = np.array([h[0] for h in self.held])
        self.wants = np.zeros((len(self.held), cells), bool)
        for row, h in zip(self.wants, self.held, strict=True):
            row[h[1]] = True
        self.ids, self.u, self.codes = (np.concatenate([h[k] for h in self.held]) for k in (2, 3, 4))
        self.starts = np.append(0, np.cumsum([len(h[2]) for h in self.held]))
        self.held = []

    def ranges(self, cell: int, place: int) -> Iterator[tuple[int, int, bool]]:
        """Rows of the left group, at most 4,096 at a time, that a block of this cell and place meets, and whether they are that block's own."""
        asking = self.wants[:, cell] & (self.places < place)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], asking.astype(np.int8), [0]])))
        for first, last in zip(self.starts[edges[::2]], self.starts[edges[1::2]], strict=True):
            for at in range(first, last, 4096):
                yield at, min(at + 4096, last), False
        for k in np.flatnonzero(self.places == place):
            yield self.starts[k], self.starts[k + 1], True


def _found(batches: Iterator[pa.RecordBatch], least: float, named: bool, cells: int) -> Iterator[tuple]:
    """Of rows sorted by pair of groups, side and place: for each right block (state, its place, its ids, and chunks of left rows from `at` to `to` with the links found there as row numbers of both sides and cosines), and None after a pair's last."""
    pair, met, known = None, None, {}
    for batch in batches:
        of, side, place, cell, wanted, members = (batch.column(c) for c in ("pair", "side", "place", "cell", "cells", "members"))
        for k in range(batch.num_rows):
            if of[k].as_py() != pair:
                if pair is not None:
                    yield met, None, None, None
                pair, met = of[k].as_py(), _Met()
            here, rows = place[k].as_py(), members[k].values
            ids, u = rows.field("id").to_numpy(zero_copy_only=False), _matrix(rows.field("u"))
            if named:  # -1 for rows of several origins, which may meet all
                ends = zip(rows.field("lowest").to_pylist(), rows.field("highest").to_pylist(), strict=True)
                codes = np.array([known.setdefault(x, len(known)) if x == y else -1 for x, y in ends], np.int64)
            else:
                codes = np.full(len(ids), -1, np.int64)
            if side[k].as_py() == 0:
                met.held.append((here, wanted[k].values.to_numpy(zero_copy_only=False), ids, u, codes))
                continue
            if met.ids is None:
                met.build(cells)

            def chunks(met=met, ids=ids, u=u, codes=codes, cell=cell[k].as_py(), here=here):
                for at, to, own in met.ranges(cell, here):
                    near = met.u[at:to] @ u.T
                    flat = np.flatnonzero(near >= least)
                    i, j = np.divmod(flat, len(ids))
                    keep = (met.codes[at + i] < 0) | (met.codes[at + i] != codes[j])
                    if own:
                        keep &= met.ids[at + i] < ids[j]
                    yield at, to, i[keep], j[keep], near.ravel()[flat[keep]]

            yield met, here, ids, chunks()
    if pair is not None:
        yield met, None, None, None


def _tied(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the ends of links, in place; every node points at its root, before and after."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def _met_groups(vectors: DataFrame, least: float, lowest: str | None, highest: str | None, block: int) -> tuple[DataFrame, int] | None:
    """Blocks dealt out to the pairs of groups in which they meet others (pair, side, place, cell, cells, members), sorted in each partition, and the number of cells; None for no vectors.

    A group is a run of blocks in order of cells, of at most some 32 MB of vectors (and smaller where cores would idle). A
    block goes to each group that it needs once, and not to each cell, so what is shuffled grows with the vectors times
    the groups. A task holds the blocks of one side's group and streams the other's.
    """
    spark = vectors.sparkSession
    named = [F.col(lowest).alias("lowest"), F.col(highest).alias("highest")] if lowest else []
    rows = usable(vectors.filter(F.col(lowest).isNotNull()) if lowest else vectors)
    rows = cut(rows.select("id", "u", *named))
    n = rows.count()
    if not n:
        return None
    cells = Cells(rows, pivots(rows, n), block)
    width, shared, radius, reach = cells.pivots.shape[1], cells.shared, cells.radius, acos(max(-1.0, min(1.0, least)))

    @arrow_udf("array<int>")
    def wanted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for members, cell in batches:
            out = []
            for k in range(len(cell)):
                own, far = cell[k].as_py(), np.arccos(np.clip(_side(members, k)[1] @ shared.value.T, -1, 1))
                hit = ((far <= radius + reach + _SLACK) & (far <= far[:, own : own + 1] + 2 * reach + _SLACK)).any(0) & (radius >= 0)
                hit[:own], hit[own] = False, True
                out.append(np.flatnonzero(hit).astype(np.int32))
            yield pa.array(out, pa.list_(pa.int32()))

    parts = -(-cells.counts // block)  # blocks of each cell
    starts = np.cumsum(parts) - parts
    total = int(parts.sum())
    groups = max(-(-n * width * 8 // _GROUP), int((6 * spark.sparkContext.defaultParallelism) ** 0.5))
    size = -(-total // min(groups, total))  # blocks of a group
    groups = -(-total // size)
    ints = lambda values: F.array(*(F.lit(int(x)) for x in values))
    dealt = cells.blocks(cells.rows, *(["lowest", "highest"] if named else [])).withColumn("place", F.get(ints(starts), F.col("cell")) + F.col("block").cast("int"))
    dealt = cut(dealt.select("cell", "place", F.floor(F.col("place") / size).cast("int").alias("home"), "members", wanted(F.struct("members"), "cell").alias("cells")))
    first, last = ints(starts // size), ints(np.maximum(starts, starts + parts - 1) // size)
    needs = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(F.get(first, c), F.get(last, c)))))
    left = dealt.select(F.col("home").alias("g"), F.explode(F.filter(needs, lambda h: h >= F.col("home"))).alias("h"), F.lit(0).alias("side"), "place", "cell", "cells", "members")
    asked = dealt.select(F.col("home").alias("g"), F.explode("cells").alias("cell")).distinct()
    right = dealt.join(F.broadcast(asked), "cell").filter(F.col("home") >= F.col("g")).select("g", F.col("home").alias("h"), F.lit(1).alias("side"), "place", "cell", F.lit(None).cast("array<int>").alias("cells"), "members")
    pair = F.expr(f"cast((bigint(g) * ({2 * groups} - g + 1)) div 2 + h - g as bigint)")
    tasks = min(groups * (groups + 1) // 2, 10_000)
    met = left.unionByName(right).withColumn("pair", pair).drop("g", "h")
    return met.repartitionById(tasks, (F.col("pair") % tasks).cast("int")).sortWithinPartitions("pair", "side", "place"), len(cells.pivots)


def similar_pairs(vectors: DataFrame, least: float, lowest: str | None = None, highest: str | None = None, block: int = 256) -> DataFrame:
    """a < b and cosine of all pairs of vectors (id, embedding) whose cosine is `least` or more; exact.

    With the names of two columns, which hold a row's least and greatest origin, pairs that are all of one origin are left
    out, and rows without an origin too. Ids are distinct; copies of one vector should be one row, as each pair is a row
    here. Vectors without a direction are in no pair. An empty table has none. Pairs leave a task as they are found.
    """
    kind = "a bigint, b bigint, cosine double"
    dealt = _met_groups(vectors, least, lowest, highest, block)
    if not dealt:
        return vectors.sparkSession.createDataFrame([], kind)
    rows, cells = dealt

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, _, ids, chunks in _found(batches, least, lowest is not None, cells):
            for at, _, i, j, near in chunks or ():
                if len(i):
                    a, b = met.ids[at + i], ids[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], names=["a", "b", "cosine"])

    return rows.mapInArrow(pairs, kind)


def link_sums(vectors: DataFrame, least: float, lowest: str | None = None, highest: str | None = None, block: int = 256) -> DataFrame:
    """id, root, links and total: the same pairs as similar_pairs without a row for each, so that any number of them takes little room.

    Links that tie (id, root) connect just the vectors that the pairs connect. The sums over ids of a connected part of
    `links` and of `total` are the number of its pairs and the sum of their cosines; every pair counts at one of its ends. A task finds the
    components of the pairs in its two groups, and leaves a row for each vector in them: an id has a row for each group it meets, at most.
    """
    kind = "id bigint, root bigint, links bigint, total double"
    dealt = _met_groups(vectors, least, lowest, highest, block)
    if not dealt:
        return vectors.sparkSession.createDataFrame([], kind)
    rows, cells = dealt

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for state, place, ids, chunks in _found(batches, least, lowest is not None, cells):
            if chunks is None:
                if met is None:
                    continue
                _tied(parent, np.concatenate(a), np.concatenate(b))
                every = np.concatenate(nodes)
                low = np.full(len(every), np.iinfo(np.int64).max)
                np.minimum.at(low, parent, every)
                root, n = low[parent], np.append(links, np.zeros(len(every) - len(links), np.int64))
                keep = np.flatnonzero((root != every) | (n > 0))
                sum_of = np.append(total, np.zeros(len(every) - len(total)))
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (every, root, n, sum_of)], names=["id", "root", "links", "total"])
                met = None
                continue
            if met is not state:
                met, nodes, parent = state, [state.ids], np.arange(len(state.ids))
                links, total, a, b, waiting = np.zeros(len(parent), np.int64), np.zeros(len(parent)), [parent[:0]], [parent[:0]], 0
            own = np.flatnonzero(met.places == place)
            if len(own):
                base = met.starts[own[0]]
            else:
                base = len(parent)
                nodes.append(ids)
                parent = np.append(parent, np.arange(base, base + len(ids)))
            for at, to, i, j, near in chunks:
                links[at:to] += np.bincount(i, minlength=to - at)
                total[at:to] += np.bincount(i, near, to - at)
                apart = np.flatnonzero(parent[at + i] != parent[base + j])
                a.append(at + i[apart])
                b.append(base + j[apart])
                waiting += len(apart)
            if waiting > 1 << 18:
                _tied(parent, np.concatenate(a), np.concatenate(b))
                a, b, waiting = [parent[:0]], [parent[:0]], 0

    return rows.mapInArrow(sums, kind)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query_id, id, similarity: for each of any number of query vectors (id, embedding) its k nearest of other ids by cosine, ties to the smaller id; exact.

    A query first meets its own cell. The angle of its k-th nearest there bounds what else it needs: only cells that may
    hold a nearer vector are searched next (all of them, where its cell has fewer than k others). Queries and vectors meet
    as blocks joined by cell, and a tile keeps only the k best of each query. Vectors without a direction neither ask nor answer.
    """
    rows, asking = usable(vectors).select("id", "u"), usable(queries).select("id", "u")
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double")
    cells = Cells(rows, pivots(rows, n), block)
    right = cut(cells.blocks(cells.rows))
    asking = cut(cells.assigned(asking))

    @arrow_udf(_LINKS)
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for t in range(len(left)):
                (ids_l, u_l, _), (ids_r, u_r, _) = _side(left, t), _side(right, t)
                order = np.argsort(ids_r, kind="stable")
                ids_r = ids_r[order]
                near = u_l @ u_r[order].T
                near[ids_l[:, None] == ids_r] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(near, top, 1)
                i, j = np.nonzero(found > -np.inf)
                out.append((ids_l[i], ids_r[top[i, j]], found[i, j]))
            yield _links(out)

    def searched(rows: DataFrame) -> DataFrame:
        found = cells.tiles(cells.blocks(rows), right).select(F.inline(best("l", "r")))
        return found.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.col("cosine").alias("similarity"))

    own = cut(topmost(searched(asking.withColumn("cells", F.array("cell"))), k))
    bound = own.groupBy("query_id").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= k)
    bounded = asking.join(bound.select(F.col("query_id").alias("id"), "s"), "id", "left")
    wide = cells.asked(bounded, F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "s"))), F.lit(pi)), False)
    rest = wide.select("id", "u", "cell", F.array_except("cells", F.array("cell")).alias("cells")).filter(F.size("cells") > 0)
    return topmost(own.unionByName(searched(rest)), k)


def topmost(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each query_id of greatest similarity, ties to the smaller id; rows are cut to k in each task before they are shuffled."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
