"""Pairs of blocks: every pair once, reduced in the task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import vectors
from cohortry.operators import evaluate


def test_pairs_of_blocks_are_reduced_before_they_leave_a_task(spark):
    def each(x, y):
        return pd.DataFrame({"k": x["k"].to_numpy(), "n": len(y)})
    rows = spark.range(90, numPartitions=3).withColumnRenamed("id", "k")
    out = vectors.block_pairs(rows, rows, "k", "k", each, "k long, n long", 2, lambda p: p.groupby("k", as_index=False).sum()).collect()
    assert sorted((r["k"], r["n"]) for r in out) == [(i, 90) for i in range(90)]


def test_silhouette_and_retrieval_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 3))
    rows = spark.createDataFrame([(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(x)], "id long, v array<double>, l string").repartition(2)
    whole, cut = (evaluate.silhouette(rows, "id", "v", "l", block_rows=n).first()["silhouette"] for n in (100, 1))
    assert cut == pytest.approx(whole)
    got = evaluate.retrieval_top1(rows, rows.withColumn("v", F.transform("v", lambda c: c * 2)), "id", "v", "v", block_rows=1).first()
    assert (got["n"], got["hits"]) == (50, 50)
