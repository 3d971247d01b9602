"""Hard negatives by exact integer inner products in a residue number system (operator 11).

Vectors are integers. Every component is reduced modulo a few small odd primes to the symmetric residue, the residue matrices
are multiplied in float32, where a sum of ``DEPTH`` products stays below 2**24 and is exact, and the signed product is put
together from its residues by Chinese remaindering with symmetric mixed-radix digits. As many primes are used as the longest
vector needs: no inner product is above the largest squared length.

The anchors are met with all rows in blocks. A block is bounded in bytes and broadcast; the rows stay where they are and are
read twice a block: once for the positives, once for the negatives, whose window of scores depends on the positives. A task
keeps the best few rows of every anchor while it reads, so that at most that many rows per anchor and task are shuffled; a
window over them selects the result. Equal vectors are settled by identifier and are never written out as pairs.

Defined results
    Rows without an identifier, a label or a vector, and rows with a NULL or non-finite component, take no part. Nor do rows
    whose integer vector has a squared length of 2**62 or more: their products need not fit a long. A shorter vector counts as
    filled with zeros. Repeated rows are rows of their own: a row is "other" than an anchor if it is not that very row.
    An anchor without positives, or a positive without a negative in its window, gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Odd primes below 256: two residues multiply to at most 125 * 125.
PRIMES = tuple(p for p in range(255, 190, -2) if all(p % q for q in range(3, 16, 2)))
DEPTH = 1024
LONGEST = 2.0 ** 62
CELLS = 1 << 21


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product tells apart all integers of absolute value up to ``bound``."""
    product, n = 1, 0
    while product <= 2 * bound:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:max(1, n)]


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """float32 matrices of the symmetric residues of an integer matrix."""
    out = []
    for p in primes:
        r = np.remainder(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Symmetric residues of float32 integers below 2**24. The rounded quotient may be one off next to a half."""
    x = x - np.rint(x * np.float32(1 / p)) * np.float32(p)
    half = p // 2
    if x.size and (x.max() > half or x.min() < -half):
        x = np.where(x > half, x - p, np.where(x < -half, x + p, x))
    return x


def product(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact a @ b.T as int64, from the residues of both."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        r = _reduced(a[i][:, :DEPTH] @ b[i][:, :DEPTH].T, p)
        for at in range(DEPTH, a[i].shape[1], DEPTH):
            r = _reduced(r + _reduced(a[i][:, at:at + DEPTH] @ b[i][:, at:at + DEPTH].T, p), p)
        # the digit is what is left of the residue after the digits before it, divided by the product of their primes
        for q, d in zip(primes, digits):
            r = _reduced((r - d) * np.float32(pow(q, -1, p)), p)
        digits.append(r)
    total = digits[-1].astype(np.int64)
    for p, d in zip(primes[-2::-1], digits[-2::-1]):
        total = total * p + d.astype(np.int64)
    return total


class Best:
    """The first ``k`` rows of each of ``n`` queries: higher scores first, then smaller identifiers."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -(1 << 63), np.int64)
        self.row = np.full((n, k), (1 << 63) - 1, np.int64)

    def better(self, scores: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Which cells (row, query) would be among the first."""
        last = self.score[queries, -1]
        return (scores > last) | ((scores == last) & (rows[:, None] < self.row[queries, -1]))

    def offer(self, scores: np.ndarray, rows: np.ndarray, queries: np.ndarray, fits: np.ndarray) -> None:
        fits = fits & self.better(scores, rows, queries)
        if np.count_nonzero(fits) > 8 * self.k * len(queries) and len(scores) > self.k:
            # the k-th best of this tile is a bound as well; equal scores stay
            bound = np.partition(np.where(fits, scores, -(1 << 63)), -self.k, axis=0)[-self.k]
            fits &= scores >= bound
        r, c = np.nonzero(fits)
        if not len(r):
            return
        q, s, i = queries[c], scores[r, c], rows[r]
        seen = np.unique(q)
        q = np.concatenate((q, np.repeat(seen, self.k)))
        s = np.concatenate((s, self.score[seen].ravel()))
        i = np.concatenate((i, self.row[seen].ravel()))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, seen)
        self.score[seen] = s[first[:, None] + np.arange(self.k)]
        self.row[seen] = i[first[:, None] + np.arange(self.k)]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row) of all that was found."""
        q, j = np.nonzero(self.row < (1 << 63) - 1)
        return q, self.score[q, j], self.row[q, j]


def whole_vectors(df: DataFrame, vec_id: Column, label: Column, vector: Column, scale: float = 256.0) -> DataFrame:
    """vec_id, label, q (little-endian 32-bit integers floor(scale * x)), size, length2, row (a number of the row's own)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("size", pa.int32()), ("length2", pa.float64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = values[starts[rows, None] + np.arange(size)].astype(float)
                with np.errstate(invalid="ignore", over="ignore"):
                    x = np.floor(scale * x)
                    length2 = (x * x).sum(axis=1)
                good = length2 < LONGEST  # false for NaN, which NULL and non-finite components give
                rows, q = rows[good], np.nan_to_num(x[good]).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                                                  pa.array([v.tobytes() for v in q], pa.binary()), pa.array(np.full(len(rows), size), pa.int32()),
                                                  pa.array(length2[good])], schema=schema)
    rows = df.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector")).dropna()
    made = rows.mapInArrow(of, "vec_id long, label long, q binary, size int, length2 double")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(q: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of an integer matrix, filled with zeros."""
    vectors = q.to_pylist()
    if all(len(v) == 4 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        own = np.frombuffer(v, "<i4")
        out[i, :len(own)] = own
    return out


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
         block_bytes: int = 32 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is a stored table of :func:`whole_vectors`. A negative's score is within ``low`` and ``high`` (numerator,
    denominator) times its positive's. ``block_bytes`` bounds what is broadcast at once.
    """
    spark = vectors.sparkSession
    about = vectors.agg(F.max("length2"), F.max("size"), F.sum(F.when(anchors, 1).otherwise(0))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not about[2]:
        return empty
    width, primes = about[1], primes_for(int(about[0]) + 1)
    blocks = max(1, -(-about[2] * (4 * max(1, width) + 24 * positives) // block_bytes))
    asked = stored(vectors.filter(anchors).withColumn("block", F.pmod(F.hash("row"), F.lit(blocks))), "anchors") if blocks > 1 else vectors.filter(anchors).withColumn("block", F.lit(0))
    rounds = [_round(vectors, asked.filter(F.col("block") == b), width, primes, positives, negatives, low, high) for b in range(blocks)]
    for other in rounds[1:]:
        rounds[0] = rounds[0].union(other)
    return rounds[0]


def _tiles(batches: Iterator[pa.RecordBatch], width: int, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(identifier, label, row number, integer vectors) of as many rows as make up a tile of scores."""
    step = max(1, CELLS // max(1, n))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield *(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)), matrix(part.column(3), width)


def _round(vectors: DataFrame, block: DataFrame, width: int, primes: tuple[int, ...], positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    spark = vectors.sparkSession
    # bounded by block_bytes
    table = block.select("vec_id", "label", "row", "q").toArrow().combine_chunks()
    ids, labels, own = (table.column(i).to_numpy() for i in range(3))
    x = matrix(table.column(3).combine_chunks() if table.num_rows else pa.array([], pa.binary()), width)
    sent = spark.sparkContext.broadcast((ids, labels, own, x.astype(np.int32)))
    rows = vectors.select("vec_id", "label", "row", "q")
    n = len(ids)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, label, row, ints = sent.value
        mine_, best = residues(ints, primes), Best(n, positives)
        of_label = {k: np.flatnonzero(label == k) for k in np.unique(label).tolist()}
        for other, others_label, others_row, q in _tiles(batches, width, n):
            theirs = residues(q, primes)
            for k in np.unique(others_label).tolist():
                c = of_label.get(k)
                if c is not None:
                    r = np.flatnonzero(others_label == k)
                    best.offer(product([m[r] for m in theirs], [m[c] for m in mine_], primes), other[r], c, others_row[r, None] != row[c])
        q, s, i = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], names=["anchor", "score", "found"])
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "found"))
    near = rows.mapInArrow(same, "anchor long, score long, found long").withColumn("slot", first - 1).filter(F.col("slot") < positives)
    known = near.toArrow()  # at most ``positives`` rows an anchor of the block
    score = np.zeros((n, positives), np.int64)
    found = np.full((n, positives), -1, np.int64)
    have = np.zeros((n, positives), bool)
    if known.num_rows:
        at = known.column("anchor").to_numpy(), known.column("slot").to_numpy()
        score[at], found[at], have[at] = known.column("score").to_numpy(), known.column("found").to_numpy(), True
    chosen = spark.sparkContext.broadcast((score, found, have))

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_id, label, _, ints = sent.value
        p, name, there = chosen.value
        # whole parts first: no overflow
        least = low[0] * (p // low[1]) - (-low[0] * (p % low[1]) // low[1])
        most = high[0] * (p // high[1]) + high[0] * (p % high[1]) // high[1]
        mine_, best = residues(ints, primes), [Best(n, negatives) for _ in range(positives)]
        for other, others_label, _, q in _tiles(batches, width, n):
            s = product(residues(q, primes), mine_, primes)
            apart = others_label[:, None] != label
            for j in range(positives):
                c = np.flatnonzero(there[:, j] & (least[:, j] <= most[:, j]))
                best[j].offer(s[:, c], other, c, apart[:, c] & (s[:, c] >= least[c, j]) & (s[:, c] <= most[c, j]))
        for j in range(positives):
            q, s, i = best[j].found()
            columns = q * positives + j, anchor_id[q], name[q, j], p[q, j], i, s
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    found_ = rows.mapInArrow(unlike, "query long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("negative_score"), "negative_id"))
    return stored(found_.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
