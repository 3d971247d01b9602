"""The pivot index against all pairs."""

import numpy as np
import pytest

from cohortry.operators import nearest


def rows_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)


def by_all_pairs(queries, points):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = np.round(unit(queries) @ unit(points).T, 11)
    return {tuple(q): int(s.argmax()) for q, s in zip(queries.tolist(), sim)}


@pytest.mark.parametrize("block", [2048, 20])
def test_same_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "CELL", 40)
    rng = np.random.default_rng(5)
    hubs = rng.standard_normal((25, 12))
    points = np.vstack([hubs[rng.integers(0, 25, 900)] + 0.1 * rng.standard_normal((900, 12)), np.zeros((2, 12)), np.repeat(hubs[:1], 300, 0)])
    queries = np.vstack([points[::4] + 0.02 * rng.standard_normal((len(points[::4]), 12)), np.zeros((3, 12)), -hubs[:3], np.repeat(hubs[:1], 200, 0)])
    out = nearest.most_similar(rows_of(spark, queries), rows_of(spark, points), "id", "v", "v", computed=True).collect()
    assert {tuple(r["vector"]): r["found"] for r in out} == by_all_pairs(queries, points)
    assert sum(r["compared"] for r in out) < 0.2 * len(out) * len(np.unique(points, axis=0))


def test_ties_nulls_and_nothing(spark):
    points = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (None, [3.0, 1.0]), (1, None), (0, [1.0, None]), (2, [1.0, float("nan")])],
                                   "id long, v array<double>")
    found = lambda q: {tuple(r["vector"]): r["found"] for r in nearest.most_similar(q, points, "id", "v", "v").collect()}
    assert found(points) == {(1.0, 0.0): 3, (2.0, 0.0): 3, (0.0, 1.0): 4}
    for nothing in (points.limit(0), points.filter("id = 1")):
        assert nearest.most_similar(points, nothing, "id", "v", "v").collect() == []
        assert nearest.most_similar(nothing, points, "id", "v", "v").collect() == []
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        nearest.most_similar(points, uneven, "id", "v", "v")
