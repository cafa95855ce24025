import math
import random

import numpy as np
import pytest

from lodeglass.llm import cover_tree


def brute(rows, k, step):
    fine = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as block", "2 as pivot", "3 as v")


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "block": 40, "query_block": 7}])
def test_results_equal_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[1][1]) for i in range(150)]
    rows += [(5000, None), (5001, []), (5002, [float("nan")] * 8), (5003, [1.0, None]), (5004, [float("inf"), 1.0]), (5005, [0.5, -0.5]), (5010, [0.0] * 8), (None, [1.0] * 8)]
    random.Random(1).shuffle(rows)
    got = sorted(tuple(r) for r in cover_tree.top_k(table(spark, rows), lambda c: c % 5 == 0, 7, **options).collect())
    assert got == brute(rows, 7, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [-3.0, 900.0])]
    assert sorted(tuple(r) for r in cover_tree.top_k(table(spark, rows), lambda c: c % 20 == 0).collect()) == brute(rows, 20, 20)
    assert cover_tree.top_k(table(spark, []), lambda c: c % 20 == 0).collect() == []
    assert cover_tree.top_k(table(spark, [(0, None)]), lambda c: c % 20 == 0).collect() == []
    assert cover_tree.top_k(table(spark, [(1, [1.0])]), lambda c: c % 20 == 0).collect() == []


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] * 9 + [(1, [0.5, 0.5])] * 2 + [(2, [0.1, 0.0])]
    got = cover_tree.top_k(table(spark, rows), lambda c: c % 20 == 0, 2, block=4).collect()
    assert len(got) == 18 and {r.vec_id for r in got} == {1}


@pytest.mark.parametrize("scale", [0.0, 1.0, 30.0])
def test_trees_cover_and_separate(scale):
    rng = np.random.default_rng(5)
    x = np.round(scale * rng.normal(size=(12, 5))[rng.integers(0, 12, 700)] + 8 * rng.normal(size=(700, 5)))
    x[600:] = x[0]
    distance = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(-1))
    stack, split, deepest = [(cover_tree.build(x), 0)], 0, 0
    assert sorted(stack[0][0].rows) == list(range(700))
    while stack:
        n, depth = stack.pop()
        deepest = max(deepest, depth)
        assert n.centre in n.rows and distance(n.rows, n.centre).max() <= n.radius + 1e-9
        if not n.children:
            assert len(n.rows) <= cover_tree.LEAF or n.radius == 0
            continue
        children = [n.child(i) for i in range(len(n.children))]
        assert sorted(np.concatenate([c.rows for c in children])) == sorted(n.rows) and children[0].centre == n.centre
        assert all(c.radius <= n.radius / 2 for c in children)
        apart = distance(n.heads[:, None], n.heads[None])
        assert apart[~np.eye(len(apart), dtype=bool)].min(initial=np.inf) > n.radius / 2
        stack += [(c, depth + 1) for c in children]
        split += 1
    assert split > 3 and deepest > 1


def searched(x, queries, k):
    best = cover_tree.Best(len(queries), k)
    ids = np.arange(len(x))
    offered = cover_tree.dual(x[queries], ids[queries], cover_tree.build(x[queries]), x, ids, cover_tree.build(x), best)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -1e18
    assert (best.scores == -np.sort(-scores, axis=1)[:, :k]).all()
    return offered / len(queries) / len(x)


def test_search_prunes_where_vectors_cluster():
    rng = np.random.default_rng(9)
    spread = np.round(64 * rng.normal(size=(2000, 8)) * np.r_[1.0, 1, 1, 1, 0, 0, 0, 0])
    centres = 64 * rng.normal(size=(20, 8))
    close = np.round(centres[rng.integers(0, 20, 2000)] + 3 * rng.normal(size=(2000, 8)))
    assert searched(close, np.arange(0, 2000, 20), 20) < 0.25 and searched(spread, np.arange(0, 2000, 20), 20) < 0.4


def test_parts_of_a_search_are_merged(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SEARCHED", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    got = sorted(tuple(r) for r in cover_tree.top_k(table(spark, rows), lambda c: c % 20 == 0, 9, pivots=2, block=20).collect())
    assert got == brute(rows, 9, 20)


def test_leaves_are_searched_together():
    rng = np.random.default_rng(3)
    x = np.round(64 * (v := rng.normal(size=(1500, 64))) / np.linalg.norm(v, axis=1)[:, None])  # nearly orthogonal: children are single vectors
    queries, calls = np.arange(0, 1500, 15), []

    class Counted(cover_tree.Best):
        def offer(self, *args):
            calls.append(1)
            return super().offer(*args)

    best = Counted(len(queries), 20)
    cover_tree.dual(x[queries], queries, cover_tree.build(x[queries]), x, np.arange(1500), cover_tree.build(x), best)
    assert len(calls) < 10
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -1e18
    ids = np.lexsort((np.broadcast_to(np.arange(1500), scores.shape), -scores), axis=1)[:, :20]
    assert (best.ids == ids).all() and (best.scores == np.take_along_axis(scores, ids, 1)).all()


def test_blocks_hold_their_trees(spark):
    rng = np.random.default_rng(6)
    x = np.round(20 * rng.normal(size=(5, 4))[rng.integers(0, 5, 200)] + 3 * rng.normal(size=(200, 4)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    seen = []
    for b in cover_tree.blocks(rows, x[:2], 60, "<i1", "<f4").collect():
        here = np.frombuffer(b.v, "<i1").reshape(-1, 4)
        assert (here == x[list(b.id)]).all()
        seen += b.id
        stack, leaves = [cover_tree.Tree.unpack(b.nodes, b.radii).node(0)], 0
        assert sorted(stack[0].rows) == list(range(len(b.id)))
        while stack:
            n = stack.pop()
            assert np.sqrt(((here[n.rows] - 1.0 * here[n.centre]) ** 2).sum(1)).max() <= n.radius + 1e-9
            leaves += 0 if n.children else len(n.rows)
            stack += [n.child(i) for i in range(len(n.children))]
        assert leaves == len(b.id)
    assert sorted(seen) == list(range(200))


def test_bounds_hold_for_single_precision():
    for m in range(1, 60):
        a, b, t = np.array([m, 2 * m + 1], np.float32), np.array([-2 * m - 1, m], np.float32), 300
        highest = int(t * (a @ a))  # a's product with b + t * a, as a and b are at right angles
        assert cover_tree.bound(a[None], 0.0, b, t * math.sqrt(a @ a))[0] >= highest
        assert cover_tree.bound(b[None], np.array([t * math.sqrt(a @ a)]), a, 0.0)[0] >= highest
