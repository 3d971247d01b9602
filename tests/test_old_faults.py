"""Faults found in earlier rounds: labels of the silhouette, and the key of a stored stage."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import evaluate as g
from cohortry.sources import tables as t


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.standard_normal((15, 3)) + 4 * i for i in range(3)])
    rows = [(i, v.tolist(), "abc"[i // 15], None if i % 15 == 0 else "abc"[i // 15]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (99, None, "a", "a")], "id long, v array<double>, label string, gaps string")


@pytest.mark.parametrize("mode", ["exact", "squared"])
def test_silhouette_leaves_out_rows_without_label_or_vector(labelled, mode):
    got = {r["labeling"]: r["silhouette"] for r in g.silhouette(labelled, "id", "v", ["label", "gaps"], mode).collect()}
    alone = g.silhouette(labelled.filter("gaps IS NOT NULL"), "id", "v", "gaps", mode).first()["silhouette"]
    assert got["gaps"] == pytest.approx(alone) and got["label"] != pytest.approx(alone) and 0.3 < got["label"] < 1


def test_stage_follows_its_plan(spark, tmp_path):
    def stage(factor):
        df = spark.range(3).select((F.col("id") * factor).alias("x"), F.transform(F.array("id"), lambda v: v + factor).alias("y"))
        return sorted(r["x"] for r in t.cached_stage(spark, "planned", df, root=str(tmp_path)).collect())

    assert stage(2) == [0, 2, 4] and stage(3) == [0, 3, 6] and stage(2) == [0, 2, 4]
    stored = pathlib.Path(t.stage_root(spark, str(tmp_path)).removeprefix("file:")) / "stages"
    assert len(list(stored.glob("planned-*"))) == 2


def test_plan_fingerprint_of_wide_rows(spark):
    wide = lambda last: spark.range(2).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)], F.lit(last).alias("z"))
    assert t.plan_fingerprint(wide(1)) == t.plan_fingerprint(wide(1)) != t.plan_fingerprint(wide(2))
    assert t.plan_fingerprint(wide(1)) == t.plan_fingerprint(spark.newSession().range(2).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)], F.lit(1).alias("z")))
