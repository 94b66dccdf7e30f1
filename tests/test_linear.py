"""Squared hinge loss against a dense solver, and the exact tail of the rank sum test against counting."""

import math
from itertools import combinations

import numpy as np
from pyspark.ml.linalg import Vectors

from faultline.operators import linear, models
from faultline.operators import stats as ST


def newton(points, sign, cost):
    """Generalised Newton steps with halving on 0.5 |w|^2 + C * squared hinge."""
    w = np.zeros(points.shape[1])

    def loss(w):
        short = np.maximum(0, 1 - sign * (points @ w))
        return 0.5 * w @ w + cost * short @ short

    for _ in range(200):
        short = np.maximum(0, 1 - sign * (points @ w))
        gradient = w - 2 * cost * points.T @ (sign * short)
        inside = points[short > 0]
        move = np.linalg.solve(np.eye(len(w)) + 2 * cost * inside.T @ inside, gradient)
        step = 1.0
        while step > 1e-9 and loss(w - step * move) > loss(w):
            step /= 2
        w = w - step * move
    return w


def test_coefficients_equal_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(240, 6)) * (rng.random((240, 6)) < 0.7)
    labels = (points[:, :3] + rng.normal(size=(240, 3)) * 0.4).argmax(axis=1)
    vectors = [Vectors.dense(x) if k % 2 else Vectors.sparse(6, [(i, v) for i, v in enumerate(x) if v]) for k, x in enumerate(points)]
    rows = spark.createDataFrame([(float(y), v) for y, v in zip(labels, vectors)], ["label", "features"])
    costs = [0.01, 1.0, 100.0]
    models = linear.fit_squared_hinge(rows.repartition(3), costs, tolerance=1e-9)
    wide = np.hstack([points, np.ones((240, 1))])
    for cost, model in zip(costs, models, strict=True):
        for k in range(3):
            assert np.allclose(model.weights[:, k], newton(wide, np.where(labels == k, 1.0, -1.0), cost), atol=1e-5)
        made = model.transform(rows).toPandas()
        assert made["prediction"].tolist() == (wide @ model.weights).argmax(axis=1).tolist()


def test_rank_sum_tail_equals_counting():
    for n1, n2 in ((1, 1), (2, 5), (3, 4), (4, 3), (5, 6)):
        sums = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in np.arange(-1, n1 * n2 + 1.5, 0.5):
            assert math.isclose(ST.rank_sum_tail(n1, n2, float(u)), sum(s >= u for s in sums) / len(sums), abs_tol=1e-15)


def test_rank_sum_tail_of_a_small_and_a_very_large_sample():
    large = 10**9
    assert math.isclose(ST.rank_sum_tail(1, large, large / 2), 0.5, rel_tol=1e-6)
    for share in (0.5, 0.6, 0.7):
        u = share * 8 * large
        z = (u - 4 * large) / math.sqrt(8 * large * (large + 9) / 12)
        assert abs(ST.rank_sum_tail(8, large, u) - ST.normal_tail(z)) < 0.01


def test_neighbour_grid_equals_single_searches(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(200, 3))
    parts = rng.choice(["train", "valid", "test"], 200)
    rows = [(k, Vectors.dense(x), int(x[0] > 0), str(part)) for k, (x, part) in enumerate(zip(points, parts, strict=True))]
    data = spark.createDataFrame(rows, ["key", "features", "y", "partition"])
    settings = ["5-uniform-1", "11-distance-1", "11-uniform-2", "31-distance-2"]
    made = {r["parameters"]: r for r in models.run_grid(data, "y", "knn", settings).collect()}
    train = parts == "train"
    for setting in settings:
        k, weights, norm = setting.split("-")
        for short, name in (("val", "valid"), ("test", "test")):
            right = 0
            for at in np.flatnonzero(parts == name):
                gap = np.linalg.norm(points[train] - points[at], ord=int(norm), axis=1)
                near = np.argsort(gap, kind="stable")[: int(k)]
                vote = np.ones(len(near)) if weights == "uniform" else 1 / gap[near]
                label = points[train][near, 0] > 0
                right += (vote[label].sum() > vote[~label].sum()) == (points[at, 0] > 0)
            assert math.isclose(made[setting][f"{short}_accuracy"], right / (parts == name).sum(), abs_tol=6e-4)
