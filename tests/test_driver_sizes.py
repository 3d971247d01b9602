"""What an iterative fit sends to the driver."""

from pyspark.sql import functions as F

from cohortry.functions import blocks
from cohortry.operators import boosting


def test_only_splits_of_a_fit_come_to_the_driver(spark, monkeypatch):
    seen = []

    def spied(*args):
        found = blocks.summed(*args)
        seen.extend(v.size for v in found.values())
        return found
    monkeypatch.setattr(boosting, "summed", spied)
    x = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i))
    rows = spark.range(200, numPartitions=3).select(x.alias("features"), (F.col("id") % 3).alias("label"))
    boosting.boost(rows, "label", rounds=2, depth=3)
    assert seen and max(seen) <= 7


def test_sums_of_few_partitions_are_added_before_the_driver(spark, monkeypatch):
    got = []
    collect = type(spark.range(1)).collect

    def counted(df):
        rows = collect(df)
        got.append(len(rows))
        return rows
    table = blocks.packed(spark.range(90, numPartitions=6).select(F.array(F.col("id").cast("double")).alias("v")), "v")
    monkeypatch.setattr(type(table.table), "collect", counted)
    assert table.sums(lambda block, x, mask: {"s": x.sum(axis=0)})["s"][0] == 89 * 45 and got == [1]
