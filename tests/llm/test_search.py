from __future__ import annotations

import numpy as np
import pytest

from punctual.llm import postings

SCHEMA = "vec_id long, embedding array<float>, rank string"


def table(spark, x, more=()):
    rows = [(i, [float(v) for v in vec], "r") for i, vec in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, SCHEMA)


def exact(x, queries, k):
    found = {}
    for q in queries:
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:k]
        found[q] = [(int(i), scores[i]) for i in order]
    return found


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_order_and_scores(spark, clustered):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (6000, 24))
    if clustered:
        x = rng.normal(0, 4, (12, 24))[rng.integers(0, 12, 6000)] + 0.5 * x
    x = x.astype(np.float32).astype(np.float64)
    rows = table(spark, x)
    got = postings.nearest_neighbours(rows, rows.where("vec_id % 50 = 0")).collect()
    expect = exact(x, range(0, 6000, 50), 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(expect)
    hits = 0
    for q, own in found.items():
        assert len(own) == 20 and [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        for i, score in own:
            assert score == pytest.approx((x[i] * x[q]).sum(), rel=1e-12)
        hits += len({i for i, _ in own} & {i for i, _ in expect[q]})
    assert hits / (20 * len(expect)) >= 0.9


def test_small_tables_ties_and_bad_vectors(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [1.0, 0.0]])
    more = [(50, None, "r"), (51, [0.0, 0.0], "r"), (52, [float("nan"), 1.0], "r"), (53, [None, 1.0], "r"), (None, [1.0, 1.0], "r"), (54, [1.0, 1.0, 1.0], "r"), (3, [2.0, 0.0], "r")]
    rows = table(spark, x, more)
    got = postings.nearest_neighbours(rows, rows, k=3).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [3, 1, 4], 1: [3, 0, 4], 2: [0, 1, 3], 3: [0, 1, 4], 4: [3, 0, 1]}
    assert postings.nearest_neighbours(rows.limit(0), rows).count() == 0
    assert postings.nearest_neighbours(rows, rows.limit(0)).count() == 0


def test_blocks_of_lists_and_queries_meet(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 64)
    monkeypatch.setattr(postings, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (500, 6)).astype(np.float32).astype(np.float64)
    rows = table(spark, x)
    got = postings.nearest_neighbours(rows, rows.where("vec_id % 5 = 0"), k=7).collect()
    found = {(r.query_id, r.rank): r.vec_id for r in got}
    expect = {(q, n + 1): i for q, own in exact(x, range(0, 500, 5), 7).items() for n, (i, _) in enumerate(own)}
    assert found == expect


def test_reach_widens_with_the_number_of_lists(spark, monkeypatch):
    """Many small lists over vectors without clusters: the fixed reach misses neighbours."""
    monkeypatch.setattr(postings, "PER_LIST", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (4000, 24)).astype(np.float32).astype(np.float64)
    x /= np.sqrt(np.square(x).sum(axis=1))[:, None]
    rows = table(spark, x)
    x = x.astype(np.float32).astype(np.float64)
    got = postings.nearest_neighbours(rows, rows.where("vec_id % 20 = 0")).collect()
    expect = exact(x, range(0, 4000, 20), 20)
    assert sum(r.vec_id in {i for i, _ in expect[r.query_id]} for r in got) / (20 * len(expect)) >= 0.94


def test_a_reach_is_found_for_queries_that_are_centroids():
    rng = np.random.default_rng(3)
    centroids = rng.normal(0, 1, (300, 5))
    graph = postings.CentroidGraph(centroids)
    wanted = [[{int(i)} for i in rng.integers(0, 300, 20)] for _ in range(30)]
    least, reach = postings.fitted_reach(graph, centroids[:30], wanted)
    assert postings.recall_of(graph, centroids[:30], wanted, least, reach) >= postings.TARGET
    assert postings.fitted_reach(graph, centroids[:0], []) == (postings.LEAST, postings.REACH)
