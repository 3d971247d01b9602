"""Exact nearest neighbours by a pivot index.

Points belong to the cell of their nearest pivot, and a cell of many points is cut into rings by the distance to it. Every
ring knows its least and greatest distance, so by the triangle inequality a query that is d away from a pivot is at least
``max(d - greatest, least - d)`` away from all points of a ring. A query first looks into the ring with the lowest bound,
and then into those whose bound does not exceed the distance found; there it meets only the points whose own distance to
the pivot is within that of its own. Queries travel to rings; points stay in theirs.

Pivots are a bounded sample and decide how much is computed, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.sizes import few_rows
from ..functions.vectors import doubles, stack

#: pivots at most, and the bytes their vectors may take in each task
PIVOTS, PIVOT_BYTES = 2048, 32 << 20
#: points for each pivot, as long as these are few; rings a cell is cut into at most; rows of one side a task compares at once
CELL, RINGS, BLOCK = 512, 16, 2048
#: rows whose distances to all pivots or rings a task holds at once
STEP = 256
#: similarities are compared to 12 places; distances are off by less than this, rounding of both included
SLACK = 1e-5


def _lifted(v: np.ndarray, query: bool) -> np.ndarray:
    """Unit vectors; a zero vector gets an axis of its own, as its cosine to all others is 0."""
    size = np.linalg.norm(v, axis=1, keepdims=True)
    zero = (size[:, 0] <= 1e-12).astype(float)
    off = np.zeros_like(zero)
    return np.column_stack([np.where(size > 1e-12, v / np.maximum(size, 1e-12), 0.0), *((off, zero) if query else (zero, off))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2.0
    d += 2.0
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def _distinct(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One row per vector, with its smallest id; rows without id, or with a vector that is not all finite numbers, fall out."""
    v = doubles(col(vec))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(col(id_col).isNotNull() & F.coalesce(~bad, F.lit(False))).groupBy(v.alias("v")).agg(F.min(col(id_col)).alias("id"))


def most_similar(queries: DataFrame, points: DataFrame, id_col: str, query_vec: str, point_vec: str, pivots: int | None = None,
                 computed: bool = False) -> DataFrame:
    """(vector, found, similarity): for each distinct query vector, the point of the greatest cosine.

    Cosines are compared to 12 places, ties go to the smallest id; a zero vector has cosine 0 to everything. Rows without
    an id or with a missing or non-finite component take no part. Equal vectors are one vector on both sides, so groups of
    copies cost nothing. With ``computed`` each row also tells how many points its vector was compared with.
    Without points there are no rows.
    """
    spark = queries.sparkSession
    asked, known = _distinct(queries, id_col, query_vec), _distinct(points, id_col, point_vec).persist()
    try:
        n = known.count()
        centres = _pivots(known, n, pivots)
        id_type = known.schema["id"].dataType.simpleString()
        if not len(centres):
            out = f"vector array<double>, found {id_type}, similarity double" + (", compared long" if computed else "")
            return spark.createDataFrame([], out)
        cells, rings = _cells(known, centres, id_type)
    finally:
        known.unpersist()
    first = _rounds(asked, cells, centres, rings, id_type, None)
    reach = F.sqrt(F.greatest(2.0 - 2.0 * F.col("sim"), F.lit(0.0))) + SLACK
    rest = _rounds(first.select("v", "home", reach.alias("reach")), cells, centres, rings, id_type, "reach")
    both = first.select("v", "sim", "found", "n").unionByName(rest.select("v", "sim", "found", "n"))
    best = both.groupBy("v").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("found").alias("f"))).alias("b"), F.sum("n").alias("compared"))
    return best.select(F.col("v").alias("vector"), F.col("b.f").alias("found"), (-F.col("b.s")).alias("similarity"),
                       *(["compared"] if computed else []))


def _pivots(known: DataFrame, n: int, pivots: int | None) -> np.ndarray:
    """The points of the lowest hashes: one for every CELL points, within the bounds above."""
    if not n:
        return np.zeros((0, 2))
    row = known.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"vectors of {row['low']} to {row['high']} components")
    m = min(pivots or math.ceil(n / CELL), PIVOTS, max(1, PIVOT_BYTES // (8 * (row["high"] + 2))))
    chosen = few_rows(known.orderBy(F.xxhash64("v"), "id").limit(m).select("v"), m, "pivots")
    return _lifted(np.array([r["v"] for r in chosen], dtype=float).reshape(len(chosen), row["high"]), False)


def _nearest_pivot(points: pd.DataFrame, centres: np.ndarray) -> Iterator[pd.DataFrame]:
    """Points with the place of their nearest pivot and the distance to it, few at a time, as each has a distance to every pivot."""
    for at in range(0, len(points), STEP):
        some = points.iloc[at:at + STEP]
        d = _distances(_lifted(stack(some["v"]), False), centres)
        yield some.assign(cell=d.argmin(1).astype(np.int32), d=d.min(1))


def _cells(known: DataFrame, centres: np.ndarray, id_type: str) -> tuple[DataFrame, pd.DataFrame]:
    """Points with cell, ring and part, and (cell, ring, low, high, parts) of the at most PIVOTS * RINGS rings."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _nearest_pivot(b, centres)

    placed = known.select("id", "v").mapInPandas(assign, f"id {id_type}, v array<double>, cell int, d double")
    cuts = placed.groupBy("cell").agg(F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"),
                                      F.least(F.ceil(F.count(F.lit(1)) / float(BLOCK)), F.lit(RINGS)).alias("wanted"))
    place = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("d"))) * F.col("wanted") / RINGS)
    # the broadcast side has at most one row per pivot
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", place.cast("int")).drop("cuts", "wanted")
    rows = few_rows(ringed.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")),
                    PIVOTS * RINGS, "rings")
    rings = pd.DataFrame([tuple(r) for r in rows], columns=["cell", "ring", "low", "high", "n"])
    rings["parts"] = -(-rings["n"] // BLOCK)
    parts = F.broadcast(known.sparkSession.createDataFrame(rings[["cell", "ring", "parts"]], "cell int, ring int, parts long"))
    return ringed.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int")), rings


def _rounds(asked: DataFrame, cells: DataFrame, centres: np.ndarray, rings: pd.DataFrame, id_type: str, known: str | None) -> DataFrame:
    """(v, home, sim, found, n): the best point among the rings a query visits in this round.

    Without ``known`` it visits the ring of the lowest bound, its home; else all others that may hold a point within the
    distance in ``known``.
    """
    cell, low, high = (rings[c].to_numpy() for c in ("cell", "low", "high"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # few queries at a time: each may go to every ring
            for at in range(0, len(b), STEP):
                q = b.iloc[at:at + STEP]
                d = _distances(_lifted(stack(q["v"]), True), centres)[:, cell]
                bound = np.maximum(np.maximum(d - high, low - d), 0.0)
                # of equal bounds, the ring of the nearest pivot
                home = np.lexsort((d, bound), axis=1)[:, 0] if known is None else q["home"].to_numpy()
                if known is None:
                    row, ring = np.arange(len(q)), home
                else:
                    near = bound <= q[known].to_numpy()[:, None]
                    near[np.arange(len(q)), home] = False
                    row, ring = np.nonzero(near)
                reach = np.full(len(row), np.inf) if known is None else q[known].to_numpy()[row]
                yield pd.DataFrame({"v": q["v"].to_numpy()[row], "home": home[row].astype(np.int32), "at": ring.astype(np.int32),
                                    "d": d[row, ring], "reach": reach})

    routed = asked.mapInPandas(route, "v array<double>, home int, at int, d double, reach double")
    index = rings[["cell", "ring", "parts", "n"]].assign(at=np.arange(len(rings), dtype=np.int32))
    ring_rows = F.broadcast(asked.sparkSession.createDataFrame(index[["cell", "ring", "at", "parts"]], "cell int, ring int, at int, parts long"))
    # a query meets every part of its ring; many queries of one ring are spread over lanes, to which the ring's points go
    load = routed.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / (8.0 * BLOCK)).cast("int").alias("lanes"))
    load = ring_rows.join(load, "at")
    ask = (routed.join(F.broadcast(load.select("at", "parts", "lanes")), "at")
           .withColumn("lane", F.pmod(F.xxhash64("v", F.lit(7)), "lanes").cast("int"))
           .withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))))
    own = (cells.join(F.broadcast(load.select("cell", "ring", "at", "lanes")), ["cell", "ring"])
           .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"v": [], "home": [], "sim": [], "found": [], "n": []})
        p = p.sort_values(["d", "id"], kind="stable")
        points, ids, away, out = _lifted(stack(p["v"]), False).T, p["id"].to_numpy(), p["d"].to_numpy(), []
        q = q.sort_values("d", kind="stable")
        # with a distance to beat, small blocks of queries meet a narrow range of points
        step = BLOCK if np.isinf(q["reach"].iloc[0]) else 64
        for i in range(0, len(q), step):
            some = q.iloc[i:i + step]
            start = np.searchsorted(away, (some["d"] - some["reach"]).min(), "left")
            stop = np.searchsorted(away, (some["d"] + some["reach"]).max(), "right")
            if stop > start:
                sim = np.round(_lifted(stack(some["v"]), True) @ points[:, start:stop], 12)
                top = sim.max(1)
                # of equal similarities the smallest id
                found = [ids[start:stop][row == t].min() for row, t in zip(sim, top)]
                out.append(pd.DataFrame({"v": some["v"], "home": some["home"], "sim": top, "found": found, "n": stop - start}))
        return pd.concat(out) if out else pd.DataFrame({"v": [], "home": [], "sim": [], "found": [], "n": []})

    keys = ("at", "part", "lane")
    found = ask.select(*keys, "v", "home", "d", "reach").groupBy(*keys).cogroup(own.select(*keys, "id", "v", "d").groupBy(*keys)).applyInPandas(
        best, f"v array<double>, home int, sim double, found {id_type}, n long")
    top = F.min(F.struct((-F.col("sim")).alias("s"), F.col("found").alias("f"))).alias("b")
    return found.groupBy("v", "home").agg(top, F.sum("n").alias("n")).select("v", "home", (-F.col("b.s")).alias("sim"), F.col("b.f").alias("found"), "n")
