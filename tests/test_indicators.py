"""Sparse indicators against the dense form and against a count by hand."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.operators import features as f
from cohortry.operators import indicators as s

ROWS = [(1, "b", None, 1.5), (2, "a", "x", None), (3, "b", "", 0.0), (3, "b", "", 0.0), (4, None, "x", 2.0), (5, "c", "é", -1.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, one string, two string, num double")


def vectors(df):
    return sorted((r["id"], tuple(r["features"].toArray())) for r in df.collect())


@pytest.mark.parametrize("limit", [s.BROADCAST_BYTES, 0])
def test_equal_to_the_dense_form(table, limit):
    words = s.level_dictionary(table, ["one", "two"])
    got = s.sparse_indicators(table, ["one", "two"], words, ["id"], broadcast_bytes=limit)
    dense = f.one_hot(table.select("id", "one", "two"), ["one", "two"])
    want = sorted((r["id"], tuple(map(float, r[1:]))) for r in dense.collect())
    assert vectors(got) == want
    assert {type(r["features"]).__name__ for r in got.collect()} == {"SparseVector"}


@pytest.mark.parametrize("limit", [s.BROADCAST_BYTES, 0])
def test_rare_unknown_and_leading_numbers(spark, table, limit):
    words = s.level_dictionary(table, ["one"], min_rows=2, rare="Other")
    assert sorted(map(tuple, words.collect())) == [("one", "Other", 2, 0), ("one", "b", 3, 1)]
    more = table.union(spark.createDataFrame([(6, "never seen", None, 3.0)], table.schema))
    got = s.sparse_indicators(more, ["one"], words, ["id"], [F.col("num")], "Other", broadcast_bytes=limit)
    assert vectors(got) == [(1, (1.5, 0.0, 1.0)), (2, (0.0, 1.0, 0.0)), (3, (0.0, 0.0, 1.0)), (3, (0.0, 0.0, 1.0)),
                            (4, (2.0, 0.0, 0.0)), (5, (-1.0, 1.0, 0.0)), (6, (3.0, 1.0, 0.0))]
    left_out = s.level_dictionary(table, ["one"], min_rows=2)
    assert [tuple(r) for r in left_out.collect()] == [("one", "b", 3, 0)]


def test_nothing_and_columns_without_levels(table):
    none = table.limit(0)
    assert s.level_dictionary(none, ["one"]).collect() == []
    assert s.sparse_indicators(none, ["one"], s.level_dictionary(none, ["one"]), ["id"]).collect() == []
    blank = table.withColumn("one", F.lit(None).cast("string"))
    got = s.sparse_indicators(blank, ["one", "two"], s.level_dictionary(blank, ["one", "two"]), ["id"])
    assert dict(vectors(got))[5] == (0.0, 0.0, 1.0)
    alone = s.sparse_indicators(blank, ["one"], s.level_dictionary(blank, ["one"]), ["id"])
    assert {len(r["features"]) for r in alone.collect()} == {0}


@pytest.mark.parametrize("limit", [s.BROADCAST_BYTES, 0])
def test_many_levels_and_a_frequent_one(spark, limit):
    n = 120_000
    level = F.when(F.col("id") % 3 == 0, F.lit("often")).otherwise(F.format_string("l%06d", "id"))
    df = spark.range(n).select("id", level.alias("level"))
    words = s.level_dictionary(df, ["level"]).persist()
    assert words.count() == 80_001 and words.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, 80_000, 80_001)
    got = s.sparse_indicators(df, ["level"], words, ["id"], broadcast_bytes=limit)
    cells = got.select("id", s.vector_parts("features").alias("p")).select("id", "p.size", F.explode("p.indices").alias("place"))
    # the places follow the order of the names: all numbered levels, then the frequent one
    number = F.when(F.col("id") % 3 == 0, 80_000).otherwise(F.col("id") - F.floor(F.col("id") / 3) - 1)
    assert cells.filter((F.col("place") == number) & (F.col("size") == 80_001)).count() == cells.count() == n
    words.unpersist()


def test_parts_of_dense_and_sparse_vectors(table):
    dense = table.select("id", vector_to_array(s.sparse_vector(3, F.array(F.lit(1)), F.array(F.col("num")))).alias("v")).filter("id = 4")
    assert dense.first()["v"] == [0.0, 2.0, 0.0]
    from pyspark.ml.functions import array_to_vector
    parts = table.select(s.vector_parts(array_to_vector(F.array(F.lit(5.0), F.lit(0.0)))).alias("p")).first()["p"]
    assert parts.asDict() == {"size": 2, "indices": [0, 1], "values": [5.0, 0.0]}
