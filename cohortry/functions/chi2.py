"""Upper tail of the chi-square distribution for whole degrees of freedom."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_tail(x: float, dof: int) -> float:
    """P(X > x): a finite sum for even ``dof``; ``erfc`` plus a finite sum for odd."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    # terms are kept as logarithms: for many degrees of freedom they overflow long before exp(-half) brings them down
    first = 0.0 if dof % 2 == 0 else 0.5
    steps = dof // 2 if dof % 2 == 0 else (dof - 1) // 2
    logs = [(i + first) * math.log(half) - math.lgamma(i + first + 1.0) - half for i in range(steps)]
    total = 0.0
    if logs:
        top = max(logs)
        total = math.exp(top) * math.fsum(math.exp(v - top) for v in logs)
    return min(1.0, total + (math.erfc(math.sqrt(half)) if dof % 2 else 0.0))


def tail_column(statistic: Column, dof: Column) -> Column:
    """For result rows only (one per feature): a batch function around :func:`upper_tail`."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([upper_tail(a, int(b)) if a == a else None for a, b in zip(x, k)], dtype="float64")
    return tail(statistic, dof)
