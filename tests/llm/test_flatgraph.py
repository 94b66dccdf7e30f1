"""The flat graph against brute force: components, counts, the audit, and rows that cannot be compared."""

import numpy as np

from faultline.llm import flatgraph, neighbours

SCHEMA = "vec_id long, embedding array<double>, label int"


def labels_of(close):
    """Smallest index reachable, by repeated minima over the links."""
    found = np.arange(len(close))
    while True:
        least = np.where(close, found[None, :], len(close)).min(axis=1)
        after = np.minimum(found, least)
        if (after == found).all():
            return found
        found = after


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 400)
    monkeypatch.setattr(flatgraph, "QUERY_ROWS", 100)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(250, 24))
    points = centres[rng.integers(0, 250, 3000)] + rng.normal(size=(3000, 24)) * rng.choice([0.1, 0.25, 0.5], (3000, 1))
    points[1000:2000] = centres[0] + rng.normal(size=(1000, 24)) * 0.27
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    close = unit @ unit.T >= neighbours.COSINE
    np.fill_diagonal(close, False)
    vectors = spark.createDataFrame([(k, x.tolist(), 7) for k, x in enumerate(points)], SCHEMA)
    made = neighbours.near_duplicates(vectors).toPandas().set_index("vec_id").sort_index()
    assert made.component_id.tolist() == labels_of(close).tolist()
    assert (made.n_links.to_numpy() <= close.sum(axis=1)).all() and made.n_links.sum() >= 0.99 * close.sum()
    assert neighbours.recall(vectors) >= 0.99


def test_rows_that_cannot_be_compared(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1e-200, 0.0], 1), (4, [1e300, 1e299], 1), (5, [], 1),
        (6, [0.0, 0.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0, 0.0], 2), (9, [0.0, 1.0], 1), (9, [0.0, -1.0], 1),
        (9, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (10, None, None),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS unit", "3 AS cell", "4 AS copies")
    made = sorted(tuple(-1 if x is None else x for x in r) for r in neighbours.near_duplicates(vectors).collect())
    assert made == [
        (-1, 0, -1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True),
    ]


def test_every_vector_of_a_block_can_be_reached():
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(60, 8)) * 0.01 + x for x in rng.normal(size=(5, 8))])
    points /= np.linalg.norm(points, axis=1)[:, None]
    left, right = flatgraph.pruned_edges(points)
    inside = left // 60 == right // 60  # five parts that do not lead to one another
    cuts = np.searchsorted(left[inside], np.arange(len(points) + 1))
    starts = flatgraph.entries(points, cuts, right[inside])
    nodes, near = flatgraph.walk(points, cuts, right[inside], starts, points[:3], 0.9)
    assert len(starts) >= 5 and np.allclose(near, points[:3] @ points[nodes].T)
    assert set(np.flatnonzero(points @ points[0] >= 0.93)) <= set(nodes)
