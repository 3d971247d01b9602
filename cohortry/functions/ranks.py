"""Exact ranks and exact order statistics that no single task has to hold.

Rank statistics are computed on *tallies*, one row per distinct value with its
count, so a value that makes up a third of the table is one row before the
shuffle. A group with many distinct values is cut into value ranges: ranks are
counted inside each range and shifted by the number of rows in the ranges below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import col, safe_numeric
from .sizes import few_rows, one_row

#: distinct values one task may rank in one sorted pass
MAX_DISTINCT = 2_000_000
#: rows among which an order statistic is picked with an exact in-memory aggregate
MAX_CANDIDATES = 200_000
#: the same, summed over the columns that are picked in one job
MAX_CANDIDATES_PER_JOB = 2_000_000
#: tie-breaks at a cut that are settled on the driver
MAX_TIES = 10_000


def tally(df: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """Row count per key combination (combined on the map side)."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(n))


def _value_ranges(tallies: DataFrame, rows: DataFrame | None, value: str, by: Sequence[str], max_distinct: int):
    """(number of distinct values, cut points per group); no cut points when one pass per group will do.

    The number is sketched on ``rows``, the source of the tallies, where that is given: this
    takes a scan and no shuffle. Cut points are the distinct values whose hash falls into one
    of many classes: they balance distinct values of any type however the rows are spread
    over them, and are the same whenever they are computed, so they need not be kept.
    """
    sizes = one_row((tallies if rows is None else rows).groupBy(*by)
                    .agg(F.approx_count_distinct(value).alias("__d"))
                    .agg(F.max("__d").alias("widest"), F.sum("__d").alias("total")))
    widest, total = sizes["widest"] or 0, sizes["total"] or 0
    if widest * 1.2 <= max_distinct:
        return total, None
    step = max(1, max_distinct // 8)
    chosen = F.when(F.pmod(F.xxhash64(F.col(value)), F.lit(step)) == 0, F.col(value))
    return total, tallies.groupBy(*by).agg(F.array_sort(F.collect_set(chosen)).alias("__cuts"))


def with_ranks(tallies: DataFrame, value: str, by: Sequence[str] = (), n: str = "n",
               rank: str = "avg_rank", before: str | None = None, peers: str | None = None,
               max_distinct: int = MAX_DISTINCT, rows: DataFrame | None = None) -> DataFrame:
    """Add the average-tie rank of ``value`` within ``by`` to a tally table.

    ``tallies`` may hold a few rows per value (say, one per class): rows with equal
    value are peers whatever else they carry. Where they can be many, use
    :func:`value_ranks`. ``before`` / ``peers`` optionally name columns with the number
    of smaller and of equal rows. ``rows`` is the source of the tallies, if at hand.
    """
    by = list(by)
    _, ranges = _value_ranges(tallies, rows, value, by, max_distinct)
    return _rank_in_ranges(tallies, value, by, n, rank, before, peers, ranges)


def value_ranks(tallies: DataFrame, value: str, by: Sequence[str] = (), n: str = "n", rank: str = "avg_rank",
                max_distinct: int = MAX_DISTINCT, rows: DataFrame | None = None) -> DataFrame:
    """(by..., value, rank), one row per distinct value, to be joined back.

    A frequent value is one row here, however many tally rows carry it. The result is
    marked for broadcast when the number of distinct values was found to be small.
    """
    by = list(by)
    total, ranges = _value_ranges(tallies, rows, value, by, max_distinct)
    values = tallies.groupBy(*by, value).agg(F.sum(n).alias(n))
    ranked = _rank_in_ranges(values, value, by, n, rank, None, None, ranges).drop(n)
    return F.broadcast(ranked) if total <= 20_000 else ranked


def _rank_in_ranges(tallies, value, by, n, rank, before, peers, ranges) -> DataFrame:
    if ranges is None:
        part, shift, src = by, F.lit(0).cast("long"), tallies
    else:
        src = tallies.join(ranges, by, "left") if by else tallies.withColumn("__cuts", F.lit(one_row(ranges)["__cuts"]))
        src = src.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
        per_range = src.groupBy(*by, "__range").agg(F.sum(n).alias("__rows"))
        below = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
        per_range = per_range.select(
            *by, "__range", F.coalesce(F.sum("__rows").over(below), F.lit(0)).alias("__shift"))
        src = src.join(per_range, [*by, "__range"])
        part, shift = [*by, "__range"], F.col("__shift")
    upto = F.sum(n).over(W.partitionBy(*part).orderBy(value))
    same = F.sum(n).over(W.partitionBy(*part, value))
    out = src.withColumns({"__upto": upto, "__same": same})
    smaller = shift + F.col("__upto") - F.col("__same")
    added = {rank: smaller + (F.col("__same") + 1) / 2.0}
    if before:
        added[before] = smaller
    if peers:
        added[peers] = F.col("__same")
    return out.withColumns(added).drop("__upto", "__same", "__range", "__shift")


@dataclass
class _Bracket:
    """Where one wanted order statistic can still lie."""
    value: Column
    position: float          # 0-based, fractional positions are interpolated
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0

    def contains(self) -> Column:
        keep = self.value.isNotNull()
        if self.low is not None:
            keep = keep & (self.value >= self.low)
        if self.high is not None:
            keep = keep & (self.value <= self.high)
        return F.when(keep, self.value)

    def under(self) -> Column:
        return F.lit(False) if self.low is None else self.value < self.low


def _narrow(df: DataFrame, wide: list[_Bracket], accuracy: int) -> None:
    """Shrink every bracket to the neighbourhood its sketch points at, then count it exactly."""
    margin = 4.0 / accuracy
    asks = []
    for b in wide:
        share = (b.position - b.below) / max(b.inside - 1, 1)
        asks.append(F.percentile_approx(
            b.contains(), [max(0.0, share - margin), min(1.0, share + margin)], accuracy))
    guess = one_row(df.agg(*[a.alias(f"g{i}") for i, a in enumerate(asks)]))
    trial = [_Bracket(b.value, b.position, *map(float, guess[i])) for i, b in enumerate(wide)]
    counts = one_row(df.agg(*[c for i, t in enumerate(trial) for c in (
        F.count_if(t.under()).alias(f"b{i}"), F.count(t.contains()).alias(f"n{i}"))]))
    for i, (b, t) in enumerate(zip(wide, trial)):
        below, inside = counts[f"b{i}"], counts[f"n{i}"]
        hit = below <= math.floor(b.position) and math.ceil(b.position) < below + inside
        if not hit or inside >= b.inside:
            raise _NotNarrowing
        b.low, b.high, b.below, b.inside = t.low, t.high, below, inside


class _NotNarrowing(Exception):
    pass


def _portions(items: list, size) -> list[list]:
    """Split so that the sizes of one portion add up to what one job may hold in memory."""
    out, held = [], math.inf
    for item in items:
        if held + size(item) > MAX_CANDIDATES_PER_JOB:
            out.append([])
            held = 0
        out[-1].append(item)
        held += size(item)
    return out


def _by_full_ranks(df: DataFrame, bracket: _Bracket) -> float:
    """Order statistic from the complete rank table: the way out when sketches cannot narrow."""
    values = df.select(bracket.value.alias("v")).filter("v IS NOT NULL")
    ranked = with_ranks(tally(values, "v"), "v", before="k", peers="m")
    lo, hi = math.floor(bracket.position), math.ceil(bracket.position)
    holds = lambda p: F.max(F.when((F.col("k") <= p) & (F.col("k") + F.col("m") > p), F.col("v")))
    row = one_row(ranked.agg(holds(lo).alias("a"), holds(hi).alias("b")))
    return row["a"] + (bracket.position - lo) * (row["b"] - row["a"])


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]],
                    max_candidates: int = MAX_CANDIDATES, accuracy: int = 10_000,
                    counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, exact at any table size.

    ``wanted`` maps a name to (value, probabilities). Small columns use the exact
    ``percentile`` aggregate, as many as fit in one job. That aggregate keeps every
    distinct value in memory, so for a large column a sketch first brackets the
    position, the bracket is counted exactly, and only when few enough rows are
    left inside is the value picked; each round is one scan without a shuffle of rows.
    ``counts`` are the numbers of values per name, where the caller knows them already.
    """
    if not wanted:
        return {}
    names = list(wanted)
    values = {k: safe_numeric(v) for k, (v, _) in wanted.items()}
    if counts is None:
        found = one_row(df.agg(*[F.count(values[k]).alias(f"n{i}") for i, k in enumerate(names)]))
        counts = {k: found[f"n{i}"] for i, k in enumerate(names)}
    total = {k: counts[k] for k in names}
    out: dict[str, list[float | None]] = {k: [None] * len(wanted[k][1]) for k in names}
    few = [k for k in names if 0 < total[k] <= max_candidates]
    for small in _portions(few, total.get):
        got = one_row(df.agg(*[F.percentile(values[k], list(map(float, wanted[k][1]))).alias(f"q{i}")
                               for i, k in enumerate(small)]))
        for i, k in enumerate(small):
            out[k] = list(got[f"q{i}"])
    brackets = [(k, j, _Bracket(values[k], p * (total[k] - 1), inside=total[k]))
                for k in names if total[k] > max_candidates for j, p in enumerate(wanted[k][1])]
    try:
        while wide := [b for _, _, b in brackets
                       if b.inside > max_candidates and (b.low is None or b.low < b.high)]:
            _narrow(df, wide, accuracy)
    except _NotNarrowing:
        pass
    narrow = [t for t in brackets if t[2].inside <= max_candidates]
    for fits in _portions(narrow, lambda t: t[2].inside):
        picks = one_row(df.agg(*[
            F.percentile(b.contains(), (b.position - b.below) / max(b.inside - 1, 1)).alias(f"p{i}")
            for i, (_, _, b) in enumerate(fits)]))
        for i, (k, j, _) in enumerate(fits):
            out[k][j] = picks[f"p{i}"]
    for k, j, b in brackets:
        if b.inside > max_candidates:
            out[k][j] = b.low if b.low is not None and b.low == b.high else _by_full_ranks(df, b)
    return out


def medians(df: DataFrame, columns: Sequence[str], counts: dict[str, int] | None = None) -> dict[str, float | None]:
    found = exact_quantiles(df, {c: (col(c), [0.5]) for c in columns}, counts=counts)
    return {c: q[0] for c, q in found.items()}


def stable_key(*parts: Column | str | int) -> Column:
    """A 44-bit number that depends only on the values: the same on any cluster and partitioning.

    44 bits leave room for exact selection in doubles; equal keys are settled by a tie-break.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("#", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 11), 16, 10).cast("long")


def lowest_k(df: DataFrame, key: Column, tie: Column, k: dict, group: Column | None = None) -> Column:
    """Predicate that is true for exactly the k rows with the smallest (key, tie) of each group; rows that are equal in both
    go together, so the last of them may exceed k.

    ``k`` maps a group value to its k (use the key None without groups). The k-th
    smallest key is found by exact selection, so no class is ever sorted in one task.
    """
    asked = {g: n for g, n in k.items() if n > 0}
    if not asked:
        return F.lit(False)
    # the key is computed once per row and pass, however often it is compared
    keyed = df.select(key.alias("k"), tie.alias("t"), (F.lit(None) if group is None else group).alias("g"))
    part = lambda g, column: F.lit(True) if group is None else is_group(column, g)
    mine = {g: part(g, F.col("g")) for g in asked}
    sizes = one_row(keyed.agg(*[F.count_if(mine[g]).alias(f"c{i}") for i, g in enumerate(asked)]))
    size = {g: sizes[f"c{i}"] for i, g in enumerate(asked)}
    whole = [g for g in asked if asked[g] >= size[g]]
    cut_groups = [g for g in asked if asked[g] < size[g]]
    chosen = F.lit(False)
    for g in whole:
        chosen = chosen | part(g, group)
    if not cut_groups:
        return chosen
    found = exact_quantiles(
        keyed, {str(i): (F.when(mine[g], F.col("k")), [(asked[g] - 1) / (size[g] - 1)]) for i, g in enumerate(cut_groups)},
        counts={str(i): size[g] for i, g in enumerate(cut_groups)})
    cuts = {g: round(found[str(i)][0]) for i, g in enumerate(cut_groups)}
    lower = one_row(keyed.agg(*[F.count_if(mine[g] & (F.col("k") < cuts[g])).alias(f"n{i}") for i, g in enumerate(cut_groups)]))
    # rows at a cut share their key with few others or none; the tie-break column decides among them
    slot = F.lit(None).cast("int")
    for i, g in enumerate(cut_groups):
        slot = F.when(mine[g] & (F.col("k") == cuts[g]), i).otherwise(slot)
    at_cut = keyed.select(slot.alias("i"), "t").filter(F.col("i").isNotNull())
    last = _tie_cuts(at_cut, {i: asked[g] - lower[f"n{i}"] for i, g in enumerate(cut_groups)})
    for i, g in enumerate(cut_groups):
        kept = tie.isNull() if last[i] is None else tie.isNull() | (tie <= F.lit(last[i]))
        chosen = chosen | (part(g, group) & ((key < cuts[g]) | ((key == cuts[g]) & kept)))
    return chosen


def _tie_cuts(at_cut: DataFrame, wanted: dict[int, int]) -> dict:
    """Per group i the largest tie-break that is still kept, so that at least ``wanted[i]`` rows are; NULL comes first.

    Rows of one tie-break are a single row here. Few of them are settled on the driver, more by distributed ranks.
    """
    counts = at_cut.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.take(MAX_TIES + 1)
    if len(rows) > MAX_TIES:
        left = F.lit(0)
        for i, n in wanted.items():
            left = F.when(F.col("i") == i, F.lit(n)).otherwise(left)
        kept = with_ranks(counts, "t", ["i"], before="__before").filter(F.col("__before") < left)
        found = few_rows(kept.groupBy("i").agg(F.max("t").alias("t")), len(wanted), "groups that are cut")
        return {i: None for i in wanted} | {r["i"]: r["t"] for r in found}
    last = {}
    for i, n in wanted.items():
        last[i], before = None, 0
        for r in sorted((r for r in rows if r["i"] == i), key=lambda r: (r["t"] is not None, r["t"])):
            if before >= n:
                break
            last[i], before = r["t"], before + r["n"]
    return last


def is_group(group: Column, value) -> Column:
    return group.isNull() if value is None else F.coalesce(group == F.lit(value), F.lit(False))
