"""Registered predictions boost as many rounds, and grow as many trees, as the operator does by default."""

import inspect

import numpy as np
import pytest

import __spark_entry__ as entry
from cohortry.operators import boosting, predict
from tests.conftest import SMALL


class Called(Exception):
    pass


@pytest.mark.parametrize("query", ["predict_clusters", "predict_low_outcome", "predict_low_outcome_strict", "train_classifiers"])
def test_full_number_of_rounds(spark, monkeypatch, query):
    whole = inspect.signature(predict.train_classifiers)

    def spy(*args, **named):
        bound = whole.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(predict, "train_classifiers", spy)
    with pytest.raises(Called) as got:
        entry.queries()[query](spark, SMALL)
    assert {n: got.value.args[0][n] for n in ("rounds", "trees", "models")} == {"rounds": 300, "trees": 300, "models": ("LR", "RF", "GBT")}


def test_features_of_few_bins_share_a_code_with_the_same_sums():
    rng = np.random.default_rng(3)
    sizes = np.array([2, 64, 2, 1, 5, 300, 2, 3])
    b = [rng.integers(0, n, 500) for n in sizes]
    codes = boosting.Codes(sizes)
    packed = codes.of(b)
    assert len(codes.groups) == 3 and sorted(sum(codes.groups, [])) == list(range(8)) and packed.dtype == np.uint16
    assert all(np.array_equal(codes.bins[f][1][packed[codes.bins[f][0]]], b[f]) for f in range(8))
    g, h, slot = rng.normal(size=500), rng.random(500), rng.integers(0, 4, 500)
    sums: dict = {}
    codes.sums(packed, slot, 3, g, h, np.ones(8, bool), sums)
    got = codes.by_bin(sums, 3)
    for node in range(3):
        for f in range(8):
            want = [np.bincount(b[f][slot == node], v[slot == node], sizes[f]) for v in (g, h)]
            assert np.allclose(got[:, node, codes.edges[f]:codes.edges[f + 1]], want)


def test_a_small_table_is_boosted_in_one_pass(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal((300, 3))
    rows = spark.createDataFrame([(v.tolist(), float(v[0] > 0)) for v in x], "features array<double>, label double").repartition(4)
    seen, summed = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda *args: (seen.append(1), summed(*args))[1])
    model = boosting.boost(rows, "label", rounds=30, depth=3)
    assert len(seen) == 1 and len(model.trees) == 30 and ((model.margins(x)[:, 0] > 0) == (x[:, 0] > 0)).mean() > 0.9
