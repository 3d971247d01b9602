"""Missing values, coercion, exact quantiles and ranks, and the chi-square tail."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import ranks as r
from cohortry.functions.chi2 import upper_tail
from cohortry.functions.columns import any_of, clip, code_key, is_true, melt, null_if_nan, safe_numeric, weighted_mean_available
from cohortry.functions.sizes import broadcast_if_small, few_rows
from cohortry.functions.vectors import block_pairs


def test_missing_never_triggers(spark):
    df = spark.createDataFrame([(None,), (1.0,), (float("nan"),)], "x double")
    got = df.select(is_true(F.col("x") < 5).alias("a"), any_of([safe_numeric("x") > 5, F.lit(None).cast("boolean")]).alias("b")).collect()
    assert [row["a"] for row in got] == [False, True, False]
    assert [row["b"] for row in got] == [False, False, False]


@pytest.mark.parametrize("text, want", [(" 12 ", 12.0), ("1e3", 1000.0), ("", None), ("abc", None), (None, None), ("NaN", None)])
def test_safe_numeric(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(safe_numeric("x").alias("v")).first()["v"] == want


def test_clip_and_weights_keep_null(spark):
    df = spark.createDataFrame([(None, None), (2.0, None), (-1.0, 3.0)], "a double, b double")
    out = df.select(clip(F.col("a"), 0, 1).alias("c"),
                    weighted_mean_available([(F.col("a"), 0.25), (F.col("b"), 0.75)]).alias("m")).collect()
    assert [x["c"] for x in out] == [None, 1.0, 0.0]
    assert [x["m"] for x in out] == [None, 2.0, 2.0]


def test_code_key_reads_whole_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double")
    assert [x["k"] for x in df.select(code_key(F.col("x")).alias("k")).collect()] == ["1", "2.5", None]


def test_null_if_nan_and_melt(spark):
    df = null_if_nan(spark.createDataFrame([(1, float("nan"), 2.0)], "id int, a double, b double"))
    assert df.first()["a"] is None
    assert [tuple(x) for x in melt(df, ["id"], ["a", "b"]).collect()] == [(1, "b", 2.0)]


def _skewed(n=4000):
    """A third of the rows share one value, and a long tail."""
    rng = np.random.default_rng(7)
    values = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.lognormal(2, 2, n), 3))
    return [(i, float(v), "a" if i % 3 else "b") for i, v in enumerate(values)]


@pytest.mark.parametrize("probability", [0.0, 0.01, 0.25, 0.3, 0.5, 0.75, 0.99, 1.0])
def test_quantiles_by_narrowing_equal_numpy(spark, probability):
    rows = _skewed()
    df = spark.createDataFrame(rows, "id int, x double, g string").cache()
    want = float(np.quantile([x[1] for x in rows], probability))
    for limit in (10_000, 300, 20):
        got = r.exact_quantiles(df, {"x": (F.col("x"), [probability])}, max_candidates=limit, accuracy=100)["x"][0]
        assert got == pytest.approx(want, rel=1e-9), limit


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert r.exact_quantiles(df, {"x": (F.col("x"), [0.5])}) == {"x": [None]}
    assert r.medians(df.limit(0), ["x"]) == {"x": None}


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_ranks_in_ranges_equal_one_pass(spark, limit):
    rows = _skewed(1500)
    df = spark.createDataFrame(rows, "id int, x double, g string")
    tallies = r.tally(df, "g", "x")
    got = {(x["g"], x["x"]): x["avg_rank"] for x in r.with_ranks(tallies, "x", ["g"], max_distinct=limit).collect()}
    alone = {x["x"]: x["avg_rank"] for x in r.with_ranks(r.tally(df, "x"), "x", max_distinct=limit).collect()}
    for group in ("a", "b"):
        values = sorted(v for _, v, g in rows if g == group)
        for v in set(values):
            places = [i + 1 for i, w in enumerate(values) if w == v]
            assert got[(group, v)] == sum(places) / len(places)
    every = sorted(v for _, v, _ in rows)
    for v in set(every):
        places = [i + 1 for i, w in enumerate(every) if w == v]
        assert alone[v] == sum(places) / len(places)


@pytest.mark.parametrize("n", [0, 1, 7, 50, 99, 100, 200])
def test_lowest_k_is_exact_under_ties(spark, n):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "id int, k int")
    kept = df.filter(r.lowest_k(df, F.col("k").cast("long"), F.col("id"), {None: n})).collect()
    want = sorted((i % 10, i) for i in range(100))[:n]
    assert sorted((x["k"], x["id"]) for x in kept) == want


@pytest.mark.parametrize("limit", [10_000, 3])
def test_lowest_k_with_any_number_of_equal_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(r, "MAX_TIES", limit)
    df = spark.range(25_000).select("id", F.when(F.col("id") < 20, 0).otherwise(1).alias("k"), (F.col("id") % 2).alias("g"))
    kept = df.filter(r.lowest_k(df, F.col("k").cast("long"), F.col("id"), {0: 12_000, 1: 11}, F.col("g")))
    got = kept.groupBy("g").agg(F.count(F.lit(1)), F.max("id")).collect()
    assert sorted(map(tuple, got)) == [(0, 12_000, 23_998), (1, 11, 21)]
    # repeated and missing ids: equal rows stay together, missing ones come first
    ids = spark.createDataFrame([(None,)] * 3 + [(7,)] * 5 + [(8,)] * 5, "id int")
    counts = lambda n: ids.filter(r.lowest_k(ids, F.lit(1).cast("long"), F.col("id"), {None: n})).count()
    assert [counts(n) for n in (1, 3, 4, 8, 9, 13, 20)] == [3, 3, 8, 8, 13, 13, 13]


def test_lowest_k_per_group_survives_repartition(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(300)], "id long, g string")
    pick = lambda d: sorted(x["id"] for x in d.filter(
        r.lowest_k(d, r.stable_key(F.col("id"), 1), F.col("id"), {"x": 50, "y": 10}, F.col("g"))).collect())
    first = pick(df)
    assert len(first) == 60 and pick(df.repartition(7, "g")) == first


def test_chi_square_tail():
    assert upper_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert upper_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert upper_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert upper_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert upper_tail(0.0, 3) == 1.0
    assert upper_tail(5000.0, 3) == 0.0
    assert math.isclose(upper_tail(2.0, 2), math.exp(-1.0))


def test_few_rows_refuses_and_broadcast_gives_way(spark):
    df = spark.range(50)
    with pytest.raises(ValueError):
        few_rows(df, 10, "rows")
    assert broadcast_if_small(df, 10) is df
    assert broadcast_if_small(df, 100).count() == 50


def test_block_pairs_meet_every_pair_once(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    import pandas as pd

    def count(x, y):
        return pd.DataFrame({"k": x["k"].to_numpy(), "n": len(y)})
    out = block_pairs(df, df, "k", "k", count, "k long, n long", block_rows=7).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert len(out) == 30 and {x["n"] for x in out} == {30}
