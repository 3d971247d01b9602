"""Classifiers on rows of which some have no label."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import predict


@pytest.mark.parametrize("model", ["LR", "RF", "GBT"])
def test_rows_without_a_label_teach_nothing(spark, model):
    x = array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")))
    rows = spark.range(60).select("id", x.alias("features"), F.when(F.col("id") % 10 != 5, (F.col("id") % 2).cast("double")).alias("label"))
    options = {"models": [model], "trees": 3, "rounds": 2}
    fitted = predict.train_classifiers(rows, **options)[model]
    alone = predict.train_classifiers(rows.filter("label IS NOT NULL"), **options)[model]
    if model == "LR":
        assert np.allclose(fitted.coefficients.toArray(), alone.coefficients.toArray())
    assert fitted.transform(rows).filter("prediction IS NOT NULL").count() == 60
