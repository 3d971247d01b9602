"""Profiles of more clusters than a driver or one row should hold."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import profile as p

N = 12_000


@pytest.fixture(scope="module")
def rows(spark):
    """Two rows per cluster; the cluster's number decides the outcome, so 0 is best and N - 1 worst."""
    ids = spark.range(2 * N).withColumn("cluster", (F.col("id") / 2).cast("long"))
    return ids.select("id", "cluster", F.col("cluster").cast("double").alias("y"), (F.col("id") % 2 + 2.0 * F.col("cluster")).alias("up"),
                      (-F.col("cluster").cast("double")).alias("down"), F.lit(1.0).alias("flat"),
                      F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v")).persist()


def test_directions(rows):
    got = {r["feature"]: r for r in p.direction_table(rows, "cluster", "y", ["up", "down", "flat"]).collect()}
    assert set(got) == {"up", "down"}
    assert (got["up"]["best_mean"], got["up"]["worst_mean"], got["down"]["delta"]) == (0.5, 2 * (N - 1) + 0.5, N - 1.0)


def test_gradient(rows):
    got = {r["outcome"]: r for r in p.gradient_summary(rows, "cluster", "y", ["flat", "down"], ["up", "down"]).collect()}
    assert (got["up"]["worst_value"], got["up"]["best_value"]) == (0.5, 2 * (N - 1) + 0.5)
    assert round(got["up"]["order_spearman"], 9) == 1.0 and round(got["down"]["order_spearman"], 9) == -1.0
    assert {(r["top_domain"], r["top_range"]) for r in got.values()} == {("down", N - 1.0)}


def test_ties_of_the_overall_mean_go_by_label(spark):
    df = spark.createDataFrame([("b", 1.0, 5.0), ("a", 1.0, 7.0), ("c", None, 9.0)], "label string, y double, out double")
    got = p.gradient_summary(df, "label", "y", [], ["out"]).collect()
    assert [tuple(r) for r in got] == [("out", 9.0, 5.0, -1.0, None, None)]


def test_prototypes(rows):
    got = p.prototype_counterfactual(rows, "id", "v", "cluster", "y", ["up", "flat"], n=2).orderBy("query_id").collect()
    assert [(r["query_id"], r["query_cluster"], r["counterfactual_id"], r["counterfactual_cluster"]) for r in got] == [
        (2 * N - 2, N - 1, 1, 0), (2 * N - 1, N - 1, 1, 0)]


def test_markers(rows):
    got = p.markers_long(rows, "cluster", ["up", "flat"])
    assert got.filter("feature = 'up'").count() == N
    assert got.filter("feature = 'up' AND mean <> 2 * label + 0.5").count() == 0
