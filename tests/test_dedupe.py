"""First of each by url or hash: equal to going through the rows one by one."""

import random

import pytest

from lodeglass.operators import joins


def brute(rows):
    urls, hashes, kept = set(), set(), []
    for n, u, h in sorted(rows):
        if u not in urls and h not in hashes:
            kept.append(n)
            urls.add(u)
            hashes.add(h)
    return kept


def got(spark, rows, **options):
    table = spark.createDataFrame(rows, "n bigint, url string, content_hash string").repartition(5)
    return sorted(r.n for r in joins.first_of_each(table, "n", **options).collect())


@pytest.mark.parametrize("small", [200_000, 40, 3])
def test_random_conflicts(spark, small):
    rng = random.Random(small)
    rows = [(i, f"u{rng.randrange(120)}", f"h{rng.randrange(150)}") for i in range(300)] + [(1000 + i, f"v{i}", f"w{i}") for i in range(50)]
    assert got(spark, rows, small=small) == brute(rows)


def test_a_chain_of_ten_thousand_takes_few_jobs(spark):
    rows = [(i, f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(10_000)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        assert got(spark, rows) == brute(rows)
        jobs = [j for j in tracker.getJobIdsForGroup("chain")]
    finally:
        spark.sparkContext.setJobGroup(None, None)
    assert len(jobs) <= 40  # Spark runs each shuffle of an adaptive plan as a job of its own; rounds would take thousands


def test_chains_that_are_too_long_for_one_task(spark):
    rows = [(1000 * k + i, f"u{k}-{(i + 1) // 2}", f"h{k}-{i // 2}") for k in range(3) for i in range(60)] + [(9000 + i, f"x{(i + 1) // 2}", f"y{i // 2}") for i in range(12)]
    assert got(spark, rows, small=100) == brute(rows) == got(spark, rows, small=30)


def test_hot_url_and_odd_rows(spark):
    rows = [(i, "hot", f"h{i}") for i in range(2000)] + [(5000 + i, f"u{i}", f"h{i}") for i in range(2000)] + [(9000, None, None), (9001, None, "z"), (9002, "", ""), (9003, "", "q")]
    want = brute([(n, u or "", h or "") if n > 9001 else (n, u if u is not None else "null", h if h is not None else "null") for n, u, h in rows])
    assert got(spark, rows) == want
    assert got(spark, []) == []
