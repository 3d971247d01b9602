"""Arithmetic on array columns, and all-pairs work cut into bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .columns import col


def doubles(vec: Column | str) -> Column:
    c = F.col(vec) if isinstance(vec, str) else vec
    return c.cast("array<double>")


def as_stored(df: DataFrame, vec: str) -> Column:
    """An array of floats as it is, half the bytes, any other as doubles; :func:`stack` makes doubles of both."""
    return col(vec) if df.schema[vec].dataType.simpleString() == "array<float>" else doubles(col(vec))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_vector(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(doubles(col(vec))))


def as_array(df: DataFrame, vec: str, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(col(vec)))


#: rows of the right side that a task meets at once stay within so many bytes
PART_BYTES = 256 << 20


def _in_blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """(n, rows): up to ``block_rows`` rows of a partition as one value."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([len(whole)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "rows"])
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, block_rows - n)
                held.append(some)
                n, batch = n + some.num_rows, batch.slice(some.num_rows)
                if n == block_rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)
    return df.mapInArrow(pack, "n long, rows binary").persist(StorageLevel.MEMORY_AND_DISK)


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int = 2048,
                merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, right_rows: int | None = None) -> DataFrame:
    """Apply ``fn`` to every (left block, right block), each of up to ``block_rows`` rows, right ones of ``right_rows`` if given.

    Blocks are cut as the rows lie, never by a data value or the ids, so no group can be hot. They are kept, and pairs of partitions
    of blocks meet in a product that reads them where they are: only the left blocks are shuffled, once, to spread the
    work. ``fn`` returns a reduced result per left row (sums, a best match), so the pairs themselves are never written
    out; ``merge`` reduces the results of one left block with several right ones once more, in the task, so that what
    leaves it does not grow with the number of right blocks.
    """
    spark = left.sparkSession
    a = _in_blocks(left, block_rows)
    b = a if right is left else _in_blocks(right, right_rows or block_rows)
    n_left = a.count()
    size = b.agg(F.coalesce(F.sum(F.length("rows")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART_BYTES))
    spread = a.select(F.col("rows").alias("x")).repartition(max(1, min(n_left, 4 * spark.sparkContext.defaultParallelism)))
    numbered = spread.select(F.monotonically_increasing_id().alias("at"), "x")
    pairs = numbered.crossJoin(b.select(F.col("rows").alias("y")).coalesce(parts).hint("shuffle_replicate_nl"))
    read = lambda value: pa.ipc.open_stream(value).read_pandas()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x, held = None, None, []

        def reduced() -> pd.DataFrame:
            whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            return whole if merge is None or len(held) == 1 else merge(whole)
        for batch in batches:
            for number, mine, other in zip(batch["at"], batch["x"], batch["y"]):
                if number != at:
                    if held:
                        yield reduced()
                    at, x, held = number, read(mine), []
                held.append(fn(x, read(other)))
                if len(held) == 16:
                    if merge is None:
                        yield reduced()
                        held = []
                    else:
                        held = [reduced()]
        if held:
            yield reduced()
    return pairs.mapInPandas(run, schema)


def stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)
