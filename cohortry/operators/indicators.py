"""Indicators of any number of levels: one sparse vector per row, the dictionary of levels as a table.

``one_hot`` and the design matrix give every level a column, so the levels pass the driver and are bounded. Here a level is
a row of a table with its position in the vector. Positions are distributed ranks, rows find theirs by a join, and the
driver sees three numbers per listed column.

Defined results: a NULL, and a level that the dictionary lacks, has no indicator; an empty text is a level like any other;
rows with equal values get equal vectors; an empty table has an empty dictionary and vectors of no indicators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.columns import col, melt
from ..functions.ranks import with_ranks
from ..functions.sizes import few_rows

#: the levels of a column are broadcast up to so many bytes
BROADCAST_BYTES = 32 << 20
#: a level with more than one in so many rows is looked up in a broadcast; there are fewer than this many of them
HOT = 1_000
SALTS = 1_024


def level_dictionary(df: DataFrame, columns: Sequence[str], min_rows: int = 1, rare: str | None = None,
                     **rank_options) -> DataFrame:
    """(feature, level, n, place): every level of the columns with its rows and its place among the column's sorted levels.

    Levels of fewer than ``min_rows`` rows are left out, or counted together as the level ``rare``. The table is read several
    times by ``sparse_indicators``, so store or persist it.
    """
    counts = melt(df, [], columns, "feature", "level", numeric=False).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    if rare is not None:
        kept = F.when(F.col("n") >= min_rows, F.col("level")).otherwise(F.lit(rare))
        counts = counts.groupBy("feature", kept.alias("level")).agg(F.sum("n").alias("n"))
    else:
        counts = counts.filter(F.col("n") >= min_rows)
    # a level is one row here, however many rows it has: its place is the number of levels before it
    ranked = with_ranks(counts.select("feature", "level", F.lit(1).cast("long").alias("n"), F.col("n").alias("rows")),
                        "level", ["feature"], before="__before", **rank_options)
    return ranked.select("feature", "level", F.col("rows").alias("n"), F.col("__before").cast("long").alias("place"))


def offsets(dictionary: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, int, int]]:
    """Per column, in the order given: (first position, levels, rows, bytes of its levels)."""
    facts = dictionary.filter(F.col("feature").isin(*columns)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("rows"), F.sum(F.octet_length("level") + 16).alias("bytes"))
    known = {r["feature"]: r for r in few_rows(facts, len(columns), "listed columns")}
    out, start = {}, 0
    for c in columns:
        r = known.get(c)
        out[c] = (start, r["levels"], r["rows"], r["bytes"]) if r else (start, 0, 0, 0)
        start += out[c][1]
    return out


def _looked_up(df: DataFrame, level: Column, side: DataFrame, rows: int, size: int, out: str, spread: Column,
               limit: int) -> DataFrame:
    """Add the place of ``level``, or NULL. A dictionary above ``limit`` bytes is joined by a shuffle, in which neither a frequent
    level nor the rows without one gather in a task: the first is broadcast with the other frequent ones, the others are salted."""
    if size <= limit:
        names = side.select(F.col("level").alias("__level"), F.col("place").alias(out))
        return df.join(F.broadcast(names), level == F.col("__level"), "left").drop("__level")
    hot = F.col("n") * HOT > rows
    often = side.filter(hot).select(F.col("level").alias("__level"), F.col("place").alias("__often"))
    seldom = side.filter(~hot).select(F.col("level").alias("__level"), F.lit(0).alias("__salt"), F.col("place").alias("__seldom"))
    met = df.join(F.broadcast(often), level == F.col("__level"), "left").drop("__level")
    asks = F.col("__often").isNull() & level.isNotNull()
    keyed = met.withColumn("__key", F.when(asks, level).otherwise("")).withColumn(
        "__own", F.when(asks, F.lit(0)).otherwise((F.pmod(spread, F.lit(SALTS)) + 1).cast("int")))
    joined = keyed.join(seldom, (F.col("__key") == F.col("__level")) & (F.col("__own") == F.col("__salt")), "left")
    return joined.withColumn(out, F.coalesce("__often", "__seldom")).drop("__often", "__seldom", "__key", "__own", "__level", "__salt")


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """ML's sparse vector of ascending indices and their values, without leaving the JVM."""
    parts = F.struct(F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")).alias("v"))
    return F.from_json(F.to_json(parts), StructType([StructField("v", VectorUDT())]))["v"]


def vector_parts(vector: str | Column) -> Column:
    """struct(size, indices, values) of a sparse vector; of a dense one, all its values."""
    schema = "v struct<type: int, size: int, indices: array<int>, values: array<double>>"
    v = F.from_json(F.to_json(F.struct((col(vector) if isinstance(vector, str) else vector).alias("v"))), schema)["v"]
    return F.when(v["type"] == 0, F.struct(v["size"].alias("size"), v["indices"].alias("indices"), v["values"].alias("values"))).otherwise(
        F.struct(F.size(v["values"]).alias("size"), F.sequence(F.lit(0), F.size(v["values"]) - 1).alias("indices"), v["values"].alias("values")))


def sparse_indicators(df: DataFrame, columns: Sequence[str], dictionary: DataFrame, keep: Sequence[str] = (),
                      lead: Sequence[Column] = (), rare: str | None = None, out: str = "features",
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keep..., sparse vector): the numbers of ``lead`` first (NULL: 0), then one indicator per level of the dictionary.

    With ``rare``, a level that the dictionary lacks counts as that level.
    """
    at = offsets(dictionary, columns)
    width = len(lead) + sum(levels for _, levels, _, _ in at.values())
    if width >= 1 << 31:
        raise ValueError(f"{width} indicators: a vector has fewer than 2^31 positions")
    names = {c: f"__place{i}" for i, c in enumerate(columns) if at[c][1]}
    rows = df.select(*[col(c).alias(f"__keep{i}") for i, c in enumerate(keep)],
                     *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"__lead{i}") for i, x in enumerate(lead)],
                     *[col(c).cast("string").alias(f"__text{i}") for i, c in enumerate(columns)])
    spread = F.xxhash64(*[F.col(c) for c in rows.columns]) if rows.columns else F.lit(0)
    # taken before any join, so that a row's salt does not change on its way
    rows = rows.withColumn("__spread", spread)
    for i, c in enumerate(columns):
        if not at[c][1]:
            continue
        side = dictionary.filter(F.col("feature") == c).select("level", "n", "place")
        rows = _looked_up(rows, F.col(f"__text{i}"), side, at[c][2], at[c][3], names[c], F.col("__spread"), broadcast_bytes)
        if rare is not None:
            other = few_rows(side.filter(F.col("level") == rare).select("place"), 1, "places of the rare level")
            if other:
                unknown = F.col(f"__text{i}").isNotNull() & F.col(names[c]).isNull()
                rows = rows.withColumn(names[c], F.when(unknown, F.lit(other[0]["place"])).otherwise(F.col(names[c])))
    places = F.array_compact(F.array(*[(F.col(p) + (len(lead) + at[c][0])).cast("int") for c, p in names.items()],
                                     F.lit(None).cast("int")))
    indices = F.concat(F.array(*[F.lit(i) for i in range(len(lead))]).cast("array<int>"), places)
    values = F.concat(F.array(*[F.col(f"__lead{i}") for i in range(len(lead))]).cast("array<double>"), F.array_repeat(F.lit(1.0), F.size(places)))
    return rows.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], sparse_vector(width, indices, values).alias(out))
