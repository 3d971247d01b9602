"""Small results on the driver, and broadcasts that are measured before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Row:
    """The single row of a global aggregate."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one row from a global aggregate")
    return rows[0]


def few_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """All rows of a result whose size has a reason to be small; refuses to go on when it is not."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many to bring to the driver")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """Broadcast a derived side only after measuring it.

    Up to ``limit`` rows the side is computed once, kept as a local relation and
    broadcast. Above that it is returned as it is, and the join is an ordinary
    shuffled one that adaptive execution may still split where a key is hot.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
