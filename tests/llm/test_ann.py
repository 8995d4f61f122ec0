import math
import random

import numpy as np

from factloom.llm import ann


def plain(rows, every, k):
    """The nearest by looking at all pairs, in double precision."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every:
            continue
        best = sorted((-float(np.float64(q @ v)), j) for b, (j, v) in enumerate(ok) if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-12)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) == len(want)


def _rows():
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 1), 3) * (1 + i % 3) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2120, [1.0, 2.0]), (2121, [0.5, 0.5])]
    return rows


def test_exact_in_one_shard_and_in_many(spark):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in _rows()], "vec_id long, embedding array<double>, shard int, rank int")
    want = plain(_rows(), 20, 7)
    same(ann.nearest(df, k=7).collect(), want)
    same(ann.nearest(df, k=7, shard_values=600, block_values=60).collect(), want)


def test_fewer_candidates_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(few).collect())) == [(0, 1, 20, 3.0), (0, 2, 1, 1.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pruning_is_exact_at_factor_one_and_keeps_recall_above():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8)) * 6
    points = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)) * 0.3
    ids = np.arange(6000)
    q = ids % 20 == 0
    truth = points[q] @ points.T
    truth[np.arange(q.sum()), ids[q]] = -np.inf
    want = np.argsort(-truth, axis=1, kind="stable")[:, :20]
    looked = {}
    for factor in (1.0, 1.1):
        tree, seen = ann.Tree(points, ids), [0]
        compare = tree._compare

        def counted(rows, at):
            seen[0] += len(rows) * len(at)
            compare(rows, at)

        tree._compare = counted
        got, _ = tree.search(points[q], ids[q], 20, factor)
        recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, want)])
        looked[factor] = seen[0]
        assert recall >= (1.0 if factor == 1.0 else 0.9), (factor, recall)
    assert looked[1.1] < looked[1.0] < q.sum() * 6000


def test_a_third_of_all_vectors_alike(spark):
    """One region then holds more than a task may, and is dealt to several shards."""
    rng = random.Random(4)
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 == 0 else [rng.gauss(0, 2) for _ in range(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    same(ann.nearest(df, k=5, shard_values=200, block_values=30).collect(), plain(rows, 20, 5))


def test_routed_recall(spark):
    """Queries go to their own region and those in reach only: all is found at factor one, nine tenths at a larger one."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 5
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=6) * 0.3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = {(q, j) for q, _, j, _ in plain(rows, 20, 10)}
    for factor, least in ((1.0, 1.0), (1.2, 0.9)):
        got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, k=10, factor=factor, shard_values=900).collect()}
        assert len(got & want) >= least * len(want)


def test_regions_hold_what_bounds_reach():
    """A region that a query's ball can't reach holds no vector as near as its k-th best."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 4)) * rng.uniform(0.2, 3, size=(4000, 1))
    regions = ann.Regions(points[::7], float((points**2).sum(axis=1).max()), 16)
    home = regions.of(points)
    assert regions.count == 16 and set(home) <= set(range(16))
    queries = points[:100]
    score = queries @ points.T
    worst = np.sort(score, axis=1)[:, -10]
    reach = {(q, r) for r, at in regions.reached(queries, worst, 1.0) for q in at.tolist()}
    assert all((q, home[p]) in reach for q, p in zip(*np.nonzero(score >= worst[:, None])))
    assert len(reach) < 100 * 16
