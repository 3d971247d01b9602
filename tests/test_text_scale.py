"""Words counted once, and products of crowded sparse rows."""

import numpy as np
import pytest

from cohortry.functions import blocks
from cohortry.operators import features


def test_words_are_counted_once_for_frequencies_and_vectors(spark):
    rows = spark.createDataFrame([(1, "bb aa bb"), (2, "aa bb cc"), (3, None), (4, "cc dd")], "id long, text string").repartition(2)
    out = features.tfidf_vectors(rows, "id", "text", min_df=2)
    assert "InMemoryTableScan" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["features"] for r in out.collect()}
    # bb comes three times; aa, "aa bb" and cc twice each
    assert all(v.size == 4 for v in got.values()) and got[3].numNonzeros() == 0
    want = np.array([1, 1, 2]) / np.sqrt(6)
    assert np.allclose(sorted(got[1].values), want) and np.allclose(got[4].values, [1.0])


@pytest.mark.parametrize("factor", [0, 64, 10**9])
def test_products_of_sparse_rows_either_way(monkeypatch, factor):
    monkeypatch.setattr(blocks, "DENSE", factor)
    monkeypatch.setattr(blocks, "CELLS", 40)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 12)) * (rng.random((30, 12)) < 0.2)
    r, c = np.nonzero(x)
    rows = blocks.SparseRows(np.concatenate(([0], np.cumsum((x != 0).sum(axis=1)))), c, x[r, c])
    m, y, into = rng.standard_normal((12, 5)), rng.standard_normal((30, 3)), np.ones((12, 3))
    rows.transposed_times(y, into)
    assert np.allclose(rows.times(m), x @ m) and np.allclose(into, 1 + x.T @ y)
