"""Iterative fits over tables of many small partitions: a pass costs a task for each, whatever the rows."""

import numpy as np
import pytest

from cohortry.functions.blocks import PARTS
from cohortry.operators import boosting, forest, predict
from cohortry.plans import flows


@pytest.fixture(scope="module")
def many(spark):
    x = np.random.default_rng(1).standard_normal((300, 3))
    return spark.createDataFrame([(i, v.tolist(), float(v[0] > 0)) for i, v in enumerate(x)], "id long, features array<double>, label double").repartition(40).cache()


def test_boosting_passes_read_few_partitions_with_the_same_draws(spark, many, monkeypatch):
    seen, summed = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda table, *args: (seen.append(table.rdd.getNumPartitions()), summed(table, *args))[1])
    model = boosting.boost(many, "label", rounds=2, depth=2)
    most = PARTS * spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() > most and 0 < max(seen) <= most
    monkeypatch.setattr(boosting, "few_parts", lambda df: df)
    again = boosting.boost(many, "label", rounds=2, depth=2)
    for a, b in zip(sum(model.trees, []), sum(again.trees, [])):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_regression_reads_few_partitions(spark, many, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    model = predict.train_classifiers(many.withColumn("features", array_to_vector("features")), models=["LR"])["LR"]
    assert seen[0] <= PARTS * spark.sparkContext.defaultParallelism and np.abs(model.coefficients.toArray()).argmax() == 0


def test_scores_are_made_once_and_rows_meet_the_trees_in_few_blocks(spark, many, monkeypatch):
    model, asked, pairs = forest.fit(many, "label", trees=3), [], forest.block_pairs
    monkeypatch.setattr(forest, "block_pairs", lambda left, *args: (asked.append(left.rdd.getNumPartitions()), pairs(left, *args))[1])
    scored = flows._scored(model, many)
    assert asked == [1] and scored.is_cached and scored.columns == ["label", "prediction", "__scores"] and scored.count() == 300


def test_a_small_table_is_boosted_without_a_shuffle(spark, many, monkeypatch):
    seen, summed = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda table, partitions, *args: (seen.append((table.rdd.getNumPartitions(), partitions)), summed(table, partitions, *args))[1])
    one = boosting.boost(many, "label", rounds=2, depth=2)
    assert set(seen) == {(1, 1)}
    # the same rows in blocks of the same numbers, of which a task gets a few
    monkeypatch.setattr(boosting, "few_parts", lambda df: df)
    monkeypatch.setattr(boosting, "CELLS", 60)
    several = boosting.boost(many, "label", rounds=2, depth=2)
    assert seen[-1] == (15, 15)
    for a, b in zip(sum(one.trees, []), sum(several.trees, [])):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_blocks_that_lie_in_one_partition_are_dealt_to_all_cores(spark, monkeypatch):
    """As of a file that is read as one: a pass of a clustering went through all rows in one task."""
    from cohortry.functions import blocks
    from cohortry.operators import many_starts
    monkeypatch.setattr(blocks, "CELLS", 60)
    x = np.random.default_rng(2).standard_normal((2000, 3))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").coalesce(1)
    made = blocks.packed(rows, "v")
    assert made.partitions == PARTS * spark.sparkContext.defaultParallelism and made.rows == 2000
    got = many_starts.k_means(made, [many_starts.Run(3, 1, 2)])[0]
    monkeypatch.setattr(blocks, "spread_blocks", lambda table: table)
    alone = blocks.packed(rows, "v")
    want = many_starts.k_means(alone, [many_starts.Run(3, 1, 2)])[0]
    assert alone.partitions == 1 and np.allclose(got.centres, want.centres) and got.cost == pytest.approx(want.cost)


def test_texts_of_one_partition_are_split_in_several_tasks(spark, monkeypatch):
    from cohortry.operators import features
    monkeypatch.setattr(features, "DEAL", 50)
    seen, fit = [], features.CountVectorizer.fit
    monkeypatch.setattr(features.CountVectorizer, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    texts = spark.createDataFrame([(i if i % 9 else None, f"the word{i % 7} and word{i % 5}" if i % 8 else None) for i in range(200)], "id long, text string").coalesce(1)
    out = features.tfidf_vectors(texts, "id", "text", min_df=2)
    assert seen[0] >= spark.sparkContext.defaultParallelism and out.count() == 200
    # few texts, and texts that lie in many partitions, stay where they are
    for docs in (texts.limit(40).coalesce(1), texts.repartition(9).cache()):
        features.tfidf_vectors(docs, "id", "text", min_df=2)
        assert seen[-1] == docs.rdd.getNumPartitions()
