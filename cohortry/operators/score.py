"""Rule scores (D1-D7): row-wise, no shuffle; only the cohort medians need a pass of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, clip01, col, is_true, safe_numeric, weighted_mean_available
from ..functions.ranks import medians

_COMPARE = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v, "==": lambda c, v: c == v,
}


@dataclass(frozen=True)
class Rule:
    """One way to impair a domain: ``column op cutoff``."""
    domain: str
    column: str
    op: str
    cutoff: float


@dataclass(frozen=True)
class StratumRule:
    """The best of several columns is under a cut-off that depends on a stratum."""
    domain: str
    columns: Sequence[str]
    stratum: str
    cutoffs: Mapping[float, float]


def _number(df: DataFrame, name: str) -> Column:
    """A column the table does not have behaves like one that is always missing."""
    return safe_numeric(col(name)) if name in df.columns else F.lit(None).cast("double")


def best_of(df: DataFrame, columns: Sequence[str]) -> Column:
    values = [_number(df, c) for c in columns]
    return F.greatest(*values) if len(values) > 1 else values[0]


def below_by_stratum(df: DataFrame, rule: StratumRule) -> Column:
    best, stratum = best_of(df, rule.columns), _number(df, rule.stratum)
    return any_of((stratum == float(s)) & (best < float(cut)) for s, cut in rule.cutoffs.items())


def domain_flags(df: DataFrame, rules: Sequence[Rule], strata: Sequence[StratumRule] = (),
                 prefix: str = "") -> DataFrame:
    """Add one 0/1 flag per domain: the OR of its rules, where a missing value triggers nothing."""
    hits: dict[str, list[Column]] = {}
    for r in rules:
        hits.setdefault(r.domain, []).append(_COMPARE[r.op](_number(df, r.column), F.lit(float(r.cutoff))))
    for s in strata:
        hits.setdefault(s.domain, []).append(below_by_stratum(df, s))
    return df.select("*", *[any_of(p).cast("int").alias(prefix + d) for d, p in hits.items()])


def grip_by_stratum(df: DataFrame, columns: Sequence[str], stratum: str, cutoffs: Mapping[float, float],
                    out: str = "grip_low") -> DataFrame:
    """Add the flag of one :class:`StratumRule`; an unknown stratum is never flagged."""
    rule = StratumRule(out, columns, stratum, cutoffs)
    return df.select("*", below_by_stratum(df, rule).cast("int").alias(out))


def impairment_total_level(df: DataFrame, flags: Sequence[str], low: int = 1, medium: int = 3,
                           prefix: str = "") -> DataFrame:
    """Add the number of flags, its level, and the inverse level."""
    total = reduce(lambda a, b: a + b, [col(f) for f in flags])
    band = lambda a, b, c: F.when(total <= low, a).when(total <= medium, b).otherwise(c)
    return df.select("*", total.cast("int").alias(f"{prefix}total"),
                     band("Low", "Medium", "High").alias(f"{prefix}level"),
                     band("High", "Medium", "Low").alias(f"{prefix}level_inv"))


# --- continuous scores -------------------------------------------------------

@dataclass(frozen=True)
class Linear:
    """clip01(a + b * x)"""
    column: str
    slope: float
    offset: float = 0.0
    clipped: bool = True


@dataclass(frozen=True)
class Centered:
    """clip01(1 - |x - centre| / width)"""
    column: str
    centre: float
    width: float


@dataclass(frozen=True)
class Speed:
    """clip01((distance / time - slow) / span); a time of zero is unknown"""
    column: str
    distance: float
    slow: float
    span: float


@dataclass(frozen=True)
class StratumScale:
    """clip01((best - low) / (high - low)), the limits depending on a stratum"""
    columns: Sequence[str]
    stratum: str
    when_equal: float
    equal_limits: tuple[float, float]
    other_limits: tuple[float, float]


@dataclass(frozen=True)
class ConditionalImpact:
    """1 - impact where impaired, else (also when unknown) 1"""
    impaired: str
    impact: str


@dataclass(frozen=True)
class Mean:
    """clip01 of the weighted mean of the parts that are present"""
    parts: Sequence[tuple[object, float]] = field(default_factory=tuple)


def conditional_impact(impaired: Column, impact: Column) -> Column:
    return F.when(is_true(impaired == 1), 1.0 - impact).otherwise(F.lit(1.0))


def score_expr(df: DataFrame, part) -> Column:
    """The Column of one score description."""
    x = lambda name: _number(df, name)
    match part:
        case Linear(column, slope, offset, clipped):
            value = F.lit(offset) + x(column) * F.lit(slope) if offset else x(column) * F.lit(slope)
            return clip01(value) if clipped else value
        case Centered(column, centre, width):
            return clip01(1.0 - F.abs(x(column) - centre) / width)
        case Speed(column, distance, slow, span):
            return clip01((F.lit(distance) / F.nullif(x(column), F.lit(0.0)) - slow) / span)
        case StratumScale(columns, stratum, when_equal, (l1, h1), (l0, h0)):
            same = is_true(x(stratum) == float(when_equal))
            low, high = (F.when(same, F.lit(float(a))).otherwise(F.lit(float(b))) for a, b in ((l1, l0), (h1, h0)))
            return clip01((best_of(df, columns) - low) / (high - low))
        case ConditionalImpact(impaired, impact):
            return conditional_impact(x(impaired), x(impact))
        case Mean(parts):
            return clip01(weighted_mean_available([(score_expr(df, p), w) for p, w in parts]))
        case Column():
            return part
    raise TypeError(f"unknown score part: {part!r}")


def weighted_mean_column(df: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """Add the weighted mean of the columns that are present in each row."""
    return df.select("*", weighted_mean_available([(_number(df, c), w) for c, w in weights.items()]).alias(out))


def score_conditional_impact(df: DataFrame, impaired: str, impact: str, out: str) -> DataFrame:
    return df.select("*", conditional_impact(_number(df, impaired), _number(df, impact)).alias(out))


def continuous_scores(df: DataFrame, scores: Mapping[str, object]) -> DataFrame:
    """Add one 0-1 score per description in ``scores``; NULL where nothing is known."""
    return df.select("*", *[score_expr(df, part).alias(name) for name, part in scores.items()])


def score_finalize(df: DataFrame, scores: Sequence[str], total: str = "total", scaled: str = "_100") -> DataFrame:
    """Missing scores become the cohort median; add x100 forms and the mean of all as the total."""
    fill = medians(df, scores)
    final = {s: F.coalesce(col(s), F.lit(fill[s]).cast("double")) for s in scores}
    mean = reduce(lambda a, b: a + b, final.values()) / F.lit(float(len(scores)))
    kept = [final[c].alias(c) if c in final else col(c) for c in df.columns]
    return df.select(*kept, *[(v * 100.0).alias(f"{s}{scaled}") for s, v in final.items()],
                     mean.alias(total), (mean * 100.0).alias(f"{total}{scaled}"))
