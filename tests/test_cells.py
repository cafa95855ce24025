"""Vector joins and components against brute force."""

import os
import random

import numpy as np
import pytest

from lodeglass.operators import cells, components, correlations


def vectors_of(spark, found, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(found)), found, strict=True)], "id bigint, embedding array<float>")


def clustered(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def cosines(found):
    unit = np.array(found, float)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize("least, block", [(0.95, 16), (0.5, 64), (-0.2, 256)])
def test_pairs_equal_brute_force(spark, least, block):
    found = clustered(400)
    got = cells.similar_pairs(vectors_of(spark, found), least, block=block).collect()
    near = cosines(found)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if near[i, j] >= least}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.cosine - near[r.a, r.b]) < 1e-9 for r in got)


def test_cells_are_pruned_where_vectors_cluster(spark):
    rows = cells.usable(vectors_of(spark, clustered(2000, 4)))
    held = cells.Cells(rows, cells.pivots(rows, 2000), 64)
    asked = held.asked(held.rows, cells.F.lit(0.2), True)
    searched = sum(int(held.counts[c]) for r in asked.select("cells").collect() for c in r.cells)
    assert searched < 0.5 * 2000 * 1000


def test_nearest_equal_brute_force(spark):
    found = [*clustered(300), *np.eye(8)[:3], [np.nan] * 8, [0.0] * 8, None]
    rows = vectors_of(spark, found)
    got = cells.nearest(rows, rows.filter("id % 7 = 0 or id > 299"), 4, block=32).collect()
    near = cosines(found[:303])
    want = {}
    for q in (q for q in range(303) if q % 7 == 0 or q > 299):
        want[q] = sorted((i for i in range(303) if i != q), key=lambda i: (-round(near[q, i], 9), i))[:4]
    assert {q: [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-round(r.similarity, 9), r.id))] for q in want} == want
    assert len(got) == 4 * len(want)


def test_vectors_of_which_a_third_are_copies(spark):
    found = clustered(300)
    found[:100] = found[0]
    rows = vectors_of(spark, found).selectExpr("id", "embedding", "concat('s', id % 3) as source")
    assert correlations.copies(rows).filter("n = 100").count() == 1
    told, members = correlations.stories(rows, 0.9)
    near, low = cosines(found), list(range(300))
    for _ in range(300):
        new = [min([low[i], *(low[j] for j in range(300) if j % 3 != i % 3 and near[i, j] >= 0.9)]) for i in range(300)]
        if new == low:
            break
        low = new
    want = {i: c for i, c in enumerate(low) if sum(c == x for x in low) > 1}
    assert {r.id: r.cluster for r in members.collect()} == want
    assert {r.cluster: r.n for r in told.collect()} == {c: sum(c == x for x in want.values()) for c in set(want.values())}
    listed = correlations.report(told, members, 2, 5).collect()
    assert len(listed) == 2 and all(len(r.ids) <= 5 for r in listed)


def test_few_and_no_vectors(spark):
    rows = vectors_of(spark, [[1, 0], [0, 1], None])
    assert cells.similar_pairs(rows.filter("false"), 0.5).count() == 0 == cells.similar_pairs(rows, 0.5).count()
    assert sorted((r.query_id, r.id) for r in cells.nearest(rows, rows, 5).collect()) == [(0, 1), (1, 0)]
    assert cells.nearest(rows.filter("false"), rows, 5).count() == 0


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (9000, 9000), (None, 3)]
    low = {x: x for a, b in links if a is not None for x in (a, b)}
    for _ in range(400):
        for a, b in links:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == low and len(got) == len(low)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("least, block, group", [(0.95, 16, 2048), (0.6, 8, 1), (0.6, 64, 1 << 20)])
def test_pairs_and_sums_by_groups_of_any_size(spark, monkeypatch, least, block, group):
    monkeypatch.setattr(cells, "_GROUP", group)
    found = clustered(300)
    rows = vectors_of(spark, found).selectExpr("id", "embedding", "if(id % 50 = 49, null, concat('s', id % 3)) as lowest", "if(id % 10 = 0, 'x', concat('s', id % 3)) as highest")
    near, (low, high) = cosines(found), zip(*[(None if i % 50 == 49 else f"s{i % 3}", "x" if i % 10 == 0 else f"s{i % 3}") for i in range(300)], strict=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j] >= least and None not in (low[i], low[j]) and len({low[i], high[i], low[j], high[j]}) > 1}
    got = cells.similar_pairs(rows, least, "lowest", "highest", block).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    of = list(range(300))
    for _ in range(300):
        for i, j in want:
            of[i] = of[j] = min(of[i], of[j])
    sums = cells.link_sums(rows, least, "lowest", "highest", block).collect()
    assert {r.id for r in sums} | {r.root for r in sums} == {i for pair in want for i in pair}
    tied = {r.id: r.component for r in components.components(spark.createDataFrame([(r.id, r.root) for r in sums], "a bigint, b bigint")).collect()}
    assert tied == {i: of[i] for pair in want for i in pair}
    for part in set(tied.values()):
        assert sum(r.links for r in sums if tied[r.id] == part) == sum(of[i] == part for i, _ in want)
        assert abs(sum(r.total for r in sums if tied[r.id] == part) - sum(near[i, j] for i, j in want if of[i] == part)) < 1e-9


def written(spark):
    """Path -> bytes of the files of this session's shuffles and checkpoints."""
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [str(spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")]
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for top in folders if top for d, _, files in os.walk(top) for f in files}


def added(spark, before):
    return sum(n for path, n in written(spark).items() if path not in before)


def test_vectors_are_not_written_for_each_cell(spark):
    rows = vectors_of(spark, np.random.default_rng(2).normal(size=(6000, 64)).astype(np.float32))
    before = written(spark)
    assert cells.similar_pairs(rows, 0.36).count() > 10_000
    assert added(spark, before) < 12 * 6000 * 64 * 8


def test_links_of_stories_are_not_written(spark):
    rows = vectors_of(spark, 1 + 0.1 * np.random.default_rng(3).random((1500, 8))).selectExpr("id", "embedding", "concat('s', id) as source")
    before = written(spark)
    told = correlations.stories(rows, 0.9)[0].collect()
    assert [(r.n, r.links) for r in told] == [(1500, 1500 * 1499 // 2)]
    assert added(spark, before) < 8 * 1500 * 1499 // 2


def test_members_of_stories_need_no_links_written(spark):
    rows = vectors_of(spark, 1 + 0.1 * np.random.default_rng(4).random((1500, 8))).selectExpr("id", "embedding", "if(id = 7, null, concat('s', id % 2)) as source")
    before = written(spark)
    got = correlations.stories(rows, 0.9)[1].collect()
    assert {(r.cluster, r.id, r.source) for r in got} == {(0, i, f"s{i % 2}") for i in range(1500) if i != 7} and len(got) == 1499
    assert added(spark, before) < 8 * 1500 * 1499 // 4
