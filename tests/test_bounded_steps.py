"""Steps whose memory, shuffles or reports must not grow faster than the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog import fixtures
from cohortry.functions import blocks, vectors
from cohortry.operators import nearest
from tests.conftest import SMALL


def test_few_points_at_a_time_meet_the_pivots(monkeypatch):
    seen, distances = [], nearest._distances
    monkeypatch.setattr(nearest, "_distances", lambda a, b: seen.append(len(a)) or distances(a, b))
    v = np.random.default_rng(1).standard_normal((3 * nearest.STEP + 5, 3))
    centres = nearest._lifted(v[:7], False)
    got = pd.concat(nearest._nearest_pivot(pd.DataFrame({"id": range(len(v)), "v": list(v)}), centres))
    whole = distances(nearest._lifted(v, False), centres)
    assert max(seen) == nearest.STEP and list(got["cell"]) == whole.argmin(1).tolist() and np.allclose(got["d"], whole.min(1))


def test_vectors_are_shuffled_as_they_are_stored(spark):
    view = fixtures.second_view(spark, SMALL)
    assert view.schema["view"].dataType.simpleString() == "array<double>"
    below = view._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "as array<double>" not in below
    for kind in ("float", "double", "int"):
        rows = spark.range(1).select(F.array(F.lit(1)).cast(f"array<{kind}>").alias("v"))
        stored = rows.select(vectors.as_stored(rows, "v").alias("v"))
        assert stored.schema["v"].dataType.simpleString() == ("array<float>" if kind == "float" else "array<double>")


def test_blocks_lie_in_few_partitions(spark):
    rows = spark.range(400, numPartitions=80).select(F.array(F.col("id").cast("double")).alias("v"))
    table = blocks.packed(rows, "v")
    assert table.rows == 400 and table.partitions <= blocks.PARTS * spark.sparkContext.defaultParallelism
    assert table.sums(lambda block, x, mask: {"s": x.sum(axis=0)})["s"][0] == 399 * 200
