"""What several corpus operators need: stored tables, word splitting, caches of encoded units."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a local one in a local session that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for NULL."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; an empty text stands for a NULL id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


class UnitCache:
    """Encoded form of text units, in two generations of at most ``limit`` units and ``chars`` characters (or one call's units,
    where those are more), so that frequent units stay and long ones cannot pile up.

    ``encode(units)`` gives the values of a list of units that are not known yet.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 400_000, chars: int = 16_000_000):
        self.encode, self.limit, self.chars, self.young, self.old, self.held = encode, limit, chars, {}, {}, 0

    def table(self, units: list[str]) -> dict:
        """A dictionary that holds every one of ``units``."""
        new = set(units).difference(self.young)
        if new:
            grows = sum(map(len, new))
            if len(self.young) + len(new) > self.limit or self.held + grows > self.chars:
                self.old, self.young, self.held = self.young, {}, 0
                new = set(units)
                grows = sum(map(len, new))
            self.held += grows
            kept = new.intersection(self.old)
            for unit in kept:
                self.young[unit] = self.old[unit]
            unknown = list(new - kept)
            self.young.update(zip(unknown, self.encode(unknown)))
        return self.young
