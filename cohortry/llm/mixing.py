"""Mixing sources to target weights by capped water-filling (operator 1).

Every source gets a share of the total by its weight, clamped at ``max_epochs`` times its size. What clamped sources leave
over is shared again by weight among the others, until none is above its clamp. A source with target ``e`` times its size
contributes every document ``floor(e)`` times, and once more the documents that come first in a seeded hash order while they
fit the fraction of ``e``, and the one document whose size comes nearest to what is then missing.

The hash order is never sorted as a whole: sizes are summed per source and range of hash values, only the range where the
target is crossed is ordered. A hot source has many ranges, so its rows are spread.

Defined results
    NULL source is a source of its own and sorts last. NULL text has size 0. A source of size 0 has target 0. Rows equal
    in identifier and text are taken equally often. An empty table gives an empty result. Only the source, identifier and
    text are read, under own names, so other columns never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, word_count

_TOP = 62
_ROWS_PER_RANGE = 2048


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded place in [0, 2^62)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - _TOP)


def _source(source: Column) -> Column:
    """A key that is never NULL and sorts by code point, NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source key, size in words, place in the order."""
    return docs.select(docs[id_col].alias("doc_id"), _source(docs[source_col]).alias("source"), word_count(docs[text_col]).alias("size"),
                       _order(docs[id_col], docs[text_col], seed).alias("place"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """source, weight: 1, 2, ... ``cycle``, repeating in the order of the keys. One row per source."""
    n = F.row_number().over(Window.orderBy("source"))
    return sources.select("source", (F.pmod(n - 1, F.lit(cycle)) + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """source, source_size, target from (source, source_size, weight); works on one row per source."""
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = max_epochs * F.col("source_size")
    full: Column = F.lit(False)
    level, clamped = 0.0, -1
    while True:
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                          F.sum(full.cast("long")).alias("n")).first()
        if row["n"] == clamped or not row["open"]:
            break
        clamped = row["n"]
        # clamped sources stay clamped, as the level only rises
        level = max(level, (total - row["used"]) / row["open"])
        full = cap <= level * F.col("weight")
    return sources.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


@dataclass
class Plan:
    """``rows``: sized rows. ``cuts``: source, source_size, target, whole epochs; one more is taken below place ``cut`` and at ``extra``."""

    rows: DataFrame
    cuts: DataFrame

    def repeats(self, joined: DataFrame) -> Column:
        return (joined["whole"] + ((joined["place"] < joined["cut"]) | (joined["place"] == joined["extra"])).cast("long")).alias("repeats")


def plan_mix(rows: DataFrame, max_epochs: float = 3.0, weights=cyclic_weights) -> Plan:
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    filled = water_fill(sums.join(weights(sums.select("source")), "source"), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(epochs + 1e-12)
    filled = stored(filled.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))), "targets")
    most = sums.agg(F.max("n")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(max(1, most / _ROWS_PER_RANGE))))
    part = F.shiftrightunsigned("place", _TOP - bits)
    ranges = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("in_part"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("until", F.sum("in_part").over(so_far)).join(filled.select("source", "rest"), "source")
    crossing = ranges.filter((F.col("until") >= F.col("rest")) & (F.col("until") - F.col("in_part") < F.col("rest"))).select(
        "source", "part", "rest", (F.col("until") - F.col("in_part")).alias("before"))
    inside = rows.withColumn("part", part).join(crossing, ["source", "part"])
    step = Window.partitionBy("source", "part").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    # rows of one place are taken together
    tied = inside.withColumn("to", F.col("before") + F.sum("size").over(step)).groupBy("source", "part", "place").agg(
        F.max("to").alias("to"), F.sum("size").alias("size"), F.first("rest").alias("rest"))
    tied = tied.withColumn("fits", F.col("to") <= F.col("rest"))
    edge = tied.groupBy("source").agg(F.min(F.when(~F.col("fits"), F.col("place"))).alias("out"), F.max(F.when(F.col("fits"), F.col("to"))).alias("filled"))
    edge = crossing.join(edge, "source").select(
        "source", (F.col("rest") - F.coalesce("filled", "before")).alias("gap"),
        F.coalesce("out", F.shiftleft(F.col("part") + 1, _TOP - bits)).alias("cut"))
    # what is left is closed by the one later place of the range whose size comes nearest
    near = F.abs(F.col("size") - F.col("gap"))
    extra = tied.filter(~F.col("fits")).join(edge.select("source", "gap"), "source").filter(near < F.col("gap")).groupBy("source").agg(
        F.min(F.struct(near.alias("near"), F.col("place"))).alias("best")).select("source", F.col("best.place").alias("extra"))
    cuts = filled.join(edge.select("source", "cut"), "source", "left").join(extra, "source", "left").select(
        "source", "source_size", "target", F.col("whole").cast("long").alias("whole"),
        F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce("cut", F.lit(1 << _TOP))).cast("long").alias("cut"),
        F.coalesce("extra", F.lit(-1)).cast("long").alias("extra"))
    return Plan(rows, stored(cuts, "cuts"))


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 11, weights=cyclic_weights) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the input's columns."""
    plan = plan_mix(stored(sized(docs, seed), "sized"), max_epochs, weights)
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), _source(docs["source"]).alias("source"),
                        _order(docs["doc_id"], docs["text"], seed).alias("place"))
    joined = whole.join(plan.cuts, "source")
    taken = joined.withColumn("repeats", plan.repeats(joined)).filter("repeats > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("doc.*")
