"""Rows packed into matrix blocks, and sums of matrices over all of them.

An iterative fit reads its rows many times. They are packed once, a few megabytes of numbers a row of the block table, which is
persisted. A pass hands every block of a partition to a function and adds what it returns; one array per name and partition
is shuffled, and the sums, whose size does not depend on the rows, come to the driver. Sums are added in the order of the
partitions, so that a fit gives the same result again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .columns import col

CELLS = 1 << 19
#: rows of which one cell in so many, or more, is there are multiplied as full matrices
DENSE = 64
#: Sums of so many partitions come to the driver as they are, of more they are added in a shuffle before, so that what it gets does
#: not grow with the rows; either way in the order of the partitions.
FEW = 1
#: partitions of blocks for each core
PARTS = 2


def as_array(df: DataFrame, name: str) -> Column:
    """A vector or array column as an array of doubles."""
    kind = df.schema[name].dataType.typeName()
    return col(name).cast("array<double>") if kind == "array" else vector_to_array(col(name))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder and read from there. Only a local session may do without the setting."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def few_parts(df: DataFrame) -> DataFrame:
    """Blocks in so few partitions that what the tasks of a pass report does not grow with the rows."""
    return df.coalesce(PARTS * df.sparkSession.sparkContext.defaultParallelism)


def spread_blocks(table: DataFrame) -> DataFrame:
    """A kept table of numbered blocks, or, where most of them lie in few partitions, as of a file that is read as one, the same
    blocks dealt to all cores. They keep their numbers, and so the draws that depend on them."""
    # a row per partition of blocks
    held = [r["count"] for r in table.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    cores = table.sparkSession.sparkContext.defaultParallelism
    if max(held, default=0) <= 2 * -(-sum(held) // cores):
        return table
    dealt = table.repartition(min(sum(held), PARTS * cores)).sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()
    table.unpersist()
    return dealt


def dense(lists: pa.ListArray) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def summed(table: DataFrame, partitions: int, each: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, dict[str, np.ndarray]]]],
           then: Callable[[str, np.ndarray], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The sums by name over all blocks of a table; ``each`` yields (block, arrays by name) for the blocks of a partition. With
    ``then`` a sum stays in the task that added it, and only what ``then(name, sum)`` makes of it comes to the driver."""
    alone = partitions <= 1  # what the task adds is the whole sum

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        least = None
        for block, some in each(batches):
            least = block if least is None else min(least, block)
            for name, value in some.items():
                total[name] = total[name] + value if name in total else np.asarray(value, float)
        if alone and then is not None:
            total = {name: np.asarray(then(name, value), float) for name, value in total.items()}
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([least] * len(total), pa.int64()), pa.array([list(v.shape) for v in total.values()], pa.list_(pa.int64())),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["name", "part", "shape", "value"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(v) for v in table.column("value").to_pylist()).reshape(table.column("shape")[0].as_py())
        if then is not None:
            total = np.asarray(then(key[0].as_py(), total), float)
        return table.slice(0, 1).set_column(2, "shape", pa.array([list(total.shape)], pa.list_(pa.int64()))).set_column(3, "value", pa.array([total.tobytes()], pa.binary()))
    schema = "name string, part long, shape array<long>, value binary"
    parts = table.mapInArrow(part, schema)
    if partitions > FEW or then is not None and not alone:
        parts = parts.groupBy("name").applyInArrow(add, schema)
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        value = np.frombuffer(bytes(r["value"])).reshape(r["shape"])
        total[r["name"]] = total[r["name"]] + value if r["name"] in total else value
    return total


@dataclass(frozen=True)
class Blocks:
    """``table``: block (its number), x (doubles), mask (one integer of bits a row). ``width``: length of the vectors."""

    table: DataFrame
    width: int
    rows: int
    partitions: int

    def free(self) -> None:
        self.table.unpersist()

    def sums(self, of: Callable[[int, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """The sums over all blocks of the arrays that ``of(block, x, mask)`` returns by name."""
        width = self.width

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
            for batch in batches:
                for block, x, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield block, of(block, np.frombuffer(x).reshape(-1, width), np.frombuffer(mask, np.int64))
        return summed(self.table, self.partitions, each)

    def pick(self, of: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(tags, rows) of all that ``of`` picks, by block. The caller keeps their number small."""
        width = self.width

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, x, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    tags, rows = of(block, np.frombuffer(x).reshape(-1, width), np.frombuffer(mask, np.int64))
                    if len(tags):
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.asarray(tags, np.int64).tobytes()], pa.binary()),
                                                          pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["block", "tags", "rows"])
        found = sorted(self.table.mapInArrow(part, "block long, tags binary, rows binary").collect(), key=lambda r: r["block"])
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, width))
        return np.concatenate([np.frombuffer(bytes(r["tags"]), np.int64) for r in found]), np.vstack([np.frombuffer(bytes(r["rows"])).reshape(-1, width) for r in found])


def packed(df: DataFrame, features: str, mask: Column | None = None) -> Blocks:
    """The rows of ``df`` with a vector. ``mask`` says bit by bit in which of several subsets a row is (all, if not given)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(0))
            step = max(1, CELLS // max(1, x.shape[1]))
            bits = batch.column(1).to_numpy()
            cut = range(0, len(x), step)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[a:a + step]).tobytes() for a in cut], pa.binary()),
                                              pa.array([bits[a:a + step].tobytes() for a in cut], pa.binary()), pa.array([len(x[a:a + step]) for a in cut], pa.int64()),
                                              pa.array([x.shape[1]] * len(cut), pa.int64())], names=["x", "mask", "n", "width"])
    rows = df.select(as_array(df, features).alias("x"), F.coalesce((F.lit(-1) if mask is None else mask).cast("long"), F.lit(0)).alias("mask")).filter("x IS NOT NULL")
    made = few_parts(rows.mapInArrow(of, "x binary, mask binary, n long, width long")).select(F.monotonically_increasing_id().alias("block"), "x", "mask", "n", "width")
    table = made.persist(StorageLevel.MEMORY_AND_DISK)
    size = table.agg(F.max("width"), F.coalesce(F.sum("n"), F.lit(0)), F.min("width")).first()
    if size[0] != size[2]:
        table.unpersist()
        raise ValueError("vectors of different lengths")
    table = spread_blocks(table)
    return Blocks(table.select("block", "x", "mask"), size[0] or 0, size[1], table.select(F.spark_partition_id().alias("p")).distinct().count())


@dataclass(frozen=True)
class SparseRows:
    """Compressed sparse rows: those of row i are ``value[edge[i]:edge[i + 1]]`` at the columns ``at``."""

    edge: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.edge) - 1

    def tiles(self, width: int) -> Iterator[tuple[int, SparseRows]]:
        """(first row, rows) with few enough values that their products with ``width`` columns stay small."""
        most, a = max(1, CELLS // max(1, width)), 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.edge, self.edge[a] + most, "right")) - 1)
            cut = slice(self.edge[a], self.edge[b])
            yield a, SparseRows(self.edge[a:b + 1] - self.edge[a], self.at[cut], self.value[cut])
            a = b

    def full(self, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, their matrix), a few megabytes at a time."""
        step = max(1, 4 * CELLS // max(1, width))
        for a in range(0, len(self), step):
            b = min(a + step, len(self))
            cut, own = slice(self.edge[a], self.edge[b]), np.repeat(np.arange(b - a), np.diff(self.edge[a:b + 1]))
            some = np.zeros((b - a, width))
            some[own, self.at[cut]] = self.value[cut]
            yield slice(a, b), some

    def crowded(self, width: int) -> bool:
        """Whether a product of full matrices is faster than one of the values alone."""
        return DENSE * len(self.at) >= len(self) * width

    def times(self, m: np.ndarray) -> np.ndarray:
        """These rows times a dense matrix."""
        out = np.zeros((len(self), m.shape[1]))
        if self.crowded(len(m)):
            for rows, some in self.full(len(m)):
                out[rows] = some @ m
            return out
        for a, t in self.tiles(m.shape[1]):
            full = np.flatnonzero(np.diff(t.edge))
            if len(full):
                out[a + full] = np.add.reduceat(t.value[:, None] * m[t.at], t.edge[full])
        return out

    def transposed_times(self, y: np.ndarray, into: np.ndarray) -> None:
        """Adds the transpose of these rows times ``y`` to ``into``."""
        if self.crowded(len(into)):
            for rows, some in self.full(len(into)):
                into += some.T @ y[rows]
            return
        for a, t in self.tiles(y.shape[1]):
            if len(t.at):
                own = np.repeat(np.arange(a, a + len(t)), np.diff(t.edge))
                order = np.argsort(t.at, kind="stable")
                first = np.flatnonzero(np.diff(t.at[order], prepend=-1))
                into[t.at[order][first]] += np.add.reduceat(t.value[order, None] * y[own[order]], first)


def sparse(column: pa.Array) -> SparseRows:
    """Rows of a column of structs (type, size, indices, values) as vectors are stored; no NULL rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = column.field("type").to_numpy(zero_copy_only=False)
    values, indices = column.field("values"), column.field("indices")
    sizes = np.diff(values.offsets.to_numpy())
    edge = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    value = values.flatten().to_numpy(zero_copy_only=False)
    at = np.zeros(len(value), np.int64)
    thin = np.repeat(kind == 0, sizes)
    at[thin] = indices.flatten().to_numpy(zero_copy_only=False)
    at[~thin] = (np.arange(len(value)) - np.repeat(edge[:-1], sizes))[~thin]
    return SparseRows(edge, at, value)


@dataclass(frozen=True)
class SparseBlocks:
    """``table``: block, edge, at, value of some rows each; vectors of ``width`` columns."""

    table: DataFrame
    width: int
    rows: int
    partitions: int

    def free(self) -> None:
        self.table.unpersist()

    def sums(self, of: Callable[[SparseRows], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
            for batch in batches:
                for block, edge, at, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    yield block, of(SparseRows(np.frombuffer(edge, np.int64), np.frombuffer(at, np.int64), np.frombuffer(value)))
        return summed(self.table, self.partitions, each)


def packed_sparse(df: DataFrame, features: str) -> SparseBlocks:
    """The rows of a vector column, as they are stored; rows without a vector are left out."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [t for _, t in sparse(batch.column(0)).tiles(1)]
            widest = max(batch.column(1).to_pylist(), default=0)
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(kind).tobytes() for a in column], pa.binary()) for column, kind in (
                ([t.edge for t in parts], np.int64), ([t.at for t in parts], np.int64), ([t.value for t in parts], float))]
                + [pa.array([len(t) for t in parts], pa.int64()), pa.array([widest] * len(parts), pa.int64())], names=["edge", "at", "value", "n", "width"])
    size = F.when(F.col("x.type") == 0, F.col("x.size")).otherwise(F.size("x.values"))
    rows = df.select(F.unwrap_udt(col(features)).alias("x")).filter("x IS NOT NULL").select("x", size.alias("size"))
    made = few_parts(rows.mapInArrow(of, "edge binary, at binary, value binary, n long, width long"))
    table = made.select(F.monotonically_increasing_id().alias("block"), "edge", "at", "value", "n", "width").persist(StorageLevel.MEMORY_AND_DISK)
    total, width = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("width")).first()
    table = spread_blocks(table)
    return SparseBlocks(table.select("block", "edge", "at", "value"), width or 0, total, table.select(F.spark_partition_id().alias("p")).distinct().count())
