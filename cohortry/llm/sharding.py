"""Sharding by a two-pass external shuffle (operator 5).

Pass 1 scatters the records by a seeded hash into buckets that fit in a task's memory. Pass 2 shuffles every bucket by Fisher
and Yates with the bucket's own seed. The buckets one after the other are a uniform order of the whole corpus; position p of n
goes to shard p * shards / n, so shard sizes differ by one row at most (law ``rows``), and the records are written by shard.

Only bucket sizes are summed up, in two levels, so that no task sees them all at 100 TB.

Defined results
    NULL text has size 8 (no bytes) and CRC 0. NULL identifiers are scattered by their text. Fully equal rows share a bucket.
    An empty table gives an empty result. The input's columns are carried along in a struct, so none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path

BUCKET_BYTES = 16 << 20


def _bucket(id_col: str, text_col: str, seed: int, buckets: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(buckets).cast("long"))


def bucket_starts(counts: DataFrame) -> DataFrame:
    """bucket, start: rows in the buckets before it, from (bucket, n). Sums go over groups of 1024 buckets first."""
    group = F.shiftright("bucket", 10)
    groups = counts.groupBy(group.alias("g")).agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("g", before(Window.orderBy("g")).alias("base"))
    inside = counts.withColumn("g", group).withColumn("inside", before(Window.partitionBy("g").orderBy("bucket")))
    return inside.join(groups, "g").select("bucket", (F.col("base") + F.col("inside")).alias("start"))


def shuffled(docs: DataFrame, shards: int, seed: int = 5, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, slot, doc: every record at its place in the shuffled corpus."""
    names = docs.columns
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("bytes")).first()
    n, buckets = int(total["n"]), max(1, math.ceil(int(total["bytes"] or 0) / bucket_bytes))
    counts = docs.groupBy(_bucket(id_col, text_col, seed, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(_bucket(id_col, text_col, seed, buckets).alias("bucket"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"),
                       F.struct(*[docs[f"`{c}`"] for c in names]).alias("doc"))
    placed = rows.join(bucket_starts(counts), "bucket")

    def fisher_yates(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        # a fixed order first: tasks may fetch their rows in any order
        table = table.sort_by("tie")
        # numpy's permutation is Fisher and Yates' shuffle
        table = table.take(pa.array(np.random.default_rng([seed, bucket]).permutation(len(table))))
        at = table.column("start").to_numpy() + np.arange(len(table))
        shard = at * shards // n
        first = -(-shard * n // shards)
        return pa.table({"shard": pa.array(shard.astype(np.int32)), "slot": pa.array(at - first), "doc": table.column("doc")})
    schema = f"shard int, slot long, doc {rows.schema['doc'].dataType.simpleString()}"
    return placed.groupBy("bucket").applyInArrow(fisher_yates, schema)


def write_shards(docs: DataFrame, shards: int, path: str | None = None, seed: int = 5, bucket_bytes: int = BUCKET_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shuffled corpus, one folder per shard, and return it as it is read back: shard, slot, doc."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    rows = shuffled(docs, shards, seed, bucket_bytes, id_col, text_col)
    rows.write.partitionBy("shard").parquet(path)
    return spark.read.schema("slot long, doc " + rows.schema["doc"].dataType.simpleString() + ", shard int").parquet(path)
