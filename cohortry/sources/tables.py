"""Reading cohort tables and stored results, and writing them (A1-A4)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from ..functions.columns import col, null_if_nan
from ..functions.sizes import one_row


def scan_cohort(spark: SparkSession, path: str, schema: StructType | str | None = None,
                columns: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a wide table lazily; only ``columns`` are read from columnar files."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV cohort needs an explicit schema")
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if columns is not None:
        df = df.select([col(c) for c in columns])
    return null_if_nan(df)


def scan_artifact(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read a stored result table: CSV with a header (a byte order mark is skipped) or parquet."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> str:
    """Write one result table; returns its path."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def sink_sheets(sheets: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """A report of several sheets becomes one table per sheet under ``folder``."""
    return {name: sink_table(df, f"{folder}/{name}", fmt) for name, df in sheets.items()}


def stage_root(spark: SparkSession, default: str | None = None) -> str:
    """Shared folder for stored stages: the cluster's checkpoint folder, else an explicit default."""
    root = spark.conf.get("spark.checkpoint.dir", None) or default
    if not root:
        raise ValueError("no shared folder: set spark.checkpoint.dir or pass a default")
    return root.rstrip("/")


def input_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the input files' names, sizes and times. Lists files in Spark, reads no content."""
    if not paths:
        return "none"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
             .select(F.xxhash64("path", "length", "modificationTime").alias("h")))
    row = one_row(files.agg(F.bit_xor("h").alias("x"), F.count("h").alias("n")))
    return f"{row['n']}-{row['x']}"


def plan_fingerprint(df: DataFrame) -> str:
    """Digest of the analysed plan. Expression ids count by first occurrence, so sessions and repeated calls agree.

    The plan holds columns, expressions and constants, but of a Python function only its name, and of a file only its schema.
    """
    # plans are printed with the settings of the thread's session, which need not be the frame's
    conf = (SparkSession.getActiveSession() or df.sparkSession).conf
    before = conf.get("spark.sql.debug.maxToStringFields", "25")
    try:
        conf.set("spark.sql.debug.maxToStringFields", str(2 ** 31 - 1))  # or wide rows would be cut short
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        conf.set("spark.sql.debug.maxToStringFields", before)
    seen: dict[str, int] = {}
    # the names of lambda variables hold a running number, too
    text = re.sub(r"(?:\b[a-z]+_[0-9]+)?#[0-9]+", lambda m: f"#{seen.setdefault(m[0], len(seen))}", text)
    return hashlib.sha256(text.encode()).hexdigest()


def cached_stage(spark: SparkSession, name: str, build: DataFrame | Callable[[], DataFrame], inputs: Sequence[str] = (),
                 params: Mapping | None = None, root: str | None = None) -> DataFrame:
    """Read a stage's stored table when its plan, inputs and parameters are unchanged, else store it anew.

    The fingerprint is part of the path, so changed code or input can never meet a stale
    result. The stored table also cuts lineage, and survives the loss of executors.
    A DataFrame is known by its plan; what that does not show (the inside of a Python function) belongs into ``params``. A
    function is for stages that run jobs while they are put together: it is called only to store, so its code is not known.
    """
    plan = [plan_fingerprint(build)] if isinstance(build, DataFrame) else []
    key = json.dumps([name, params or {}, input_fingerprint(spark, inputs), *plan], sort_keys=True, default=str)
    path = f"{stage_root(spark, root)}/stages/{name}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    try:
        # the commit marker is written last, so a half-written table is never read
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").limit(1).count()
    except AnalysisException:
        (build if plan else build()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
