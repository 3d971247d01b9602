"""Near duplicates by SimHash, found with vantage-point trees over Hamming distance (operator 7).

Two 64-bit fingerprints that differ in at most four bits differ in at most two of their upper 32 bits, or in at most one of
their lower 32. So there is one vantage-point tree over the upper halves, searched with radius 2, and one over the lower
halves, searched with radius 1; pairs are then checked on all 64 bits. A node splits by the distance to its vantage point.
Every fingerprint has one home leaf (a shard). A fingerprint within the radius of a boundary is also sent across it as a
query, and goes down every branch that the triangle inequality does not exclude, so no pair of different shards is lost.

The trees are fitted on a bounded sample (at most ``SAMPLE`` fingerprints, 16 per leaf); that decides shard sizes only. Within
a shard the same splitting goes on until the parts are small, and the shard returns a spanning forest of its links, never all
pairs. Components come from alternating stars over the forest edges, stored after every round.

Defined results
    NULL and empty texts, and texts without a word, have fingerprint 0 and link like any other. Fewer words than a shingle
    give one shingle. Equal fingerprints are one node; its representative is the smallest identifier (NULL is smallest only
    where there is no other). Repeated rows share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SAMPLE = 65_536
LEAF = 1024
_SLICE = 1 << 16


@dataclass(frozen=True)
class Half:
    """The bits that a tree looks at, and the largest distance on them that a link may have."""

    mask: int
    radius: int


def halves(bits: int) -> tuple[Half, Half]:
    """Radii r and s with (r + 1) + (s + 1) > bits: a pair within ``bits`` is within one of them."""
    upper = bits // 2
    return Half(0xFFFFFFFF00000000, upper), Half(0x00000000FFFFFFFF, max(0, bits - upper - 1))


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """Majority bits of the XXH64 values of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends.tolist()[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, _SLICE):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:at + _SLICE], last[at:at + _SLICE])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows with one identifier."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits), mark (hash of the text)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], names=["doc_id", "fp", "mark"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), text_mark(docs[text_col]).alias("mark")).mapInArrow(
        of, "doc_id long, fp long, mark long")


class Tree:
    """Vantage points and radii in heap order; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, half: Half):
        self.mask, self.r, self.depth = np.uint64(half.mask), half.radius, depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.split = np.full((1 << depth) - 1, 64, np.int64)
        parts = [sample]
        for level in range(depth):
            below = []
            for k, part in enumerate(parts):
                node = (1 << level) - 1 + k
                best = self._best(part)
                if best is None:  # nothing to tell apart: everything goes to the inner side
                    below += [part, part[:0]]
                    continue
                self.vantage[node], self.split[node] = best
                d = self._distance(part, best[0])
                below += [part[d <= best[1]], part[d > best[1]]]
            parts = below

    def _distance(self, x: np.ndarray, v) -> np.ndarray:
        return np.bitwise_count((x ^ v) & self.mask).astype(np.int64)

    def _best(self, part: np.ndarray):
        """Of a few vantage points and cuts, the one with the smallest larger side and the fewest points near the cut."""
        found = None
        for v in part[:: max(1, len(part) // 4)][:4]:
            d = self._distance(part, v)
            for cut in {int(np.median(d)), int(np.median(d)) - 1}:
                inner = int((d <= cut).sum())
                if 0 < inner < len(d):
                    near = int((np.abs(d - cut) <= self.r).sum())
                    cost = max(inner, len(d) - inner) + near / 2
                    if found is None or cost < found[0]:
                        found = cost, v, cut
        return found and found[1:]

    def route(self, x: np.ndarray, homes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into x, leaf, is home) for the home leaf of each point and for every leaf it must query. Points from
        ``homes`` on have their home elsewhere: they only ask, on both sides of a boundary that is near."""
        at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        home = at < (len(x) if homes is None else homes)
        for level in range(self.depth):
            here = (1 << level) - 1 + node
            d, cut = self._distance(x[at], self.vantage[here]), self.split[here]
            inner = np.where(home, d <= cut, d - self.r <= cut)
            # a home point of the inner side queries the outer one; the other direction would find the same pairs
            outer = np.where(home, d > cut, d + self.r > cut)
            asks = home & inner & (d + self.r > cut)
            at = np.concatenate((at[inner], at[outer], at[asks]))
            home_next = np.concatenate((home[inner], home[outer], np.zeros(asks.sum(), bool)))
            node = np.concatenate((2 * node[inner], 2 * node[outer] + 1, 2 * node[asks] + 1))
            home = home_next
        return at, node, home


def _root(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(label, up := label[label]):
        label = up
    return label


def _brute(x: np.ndarray, homes: int, bits: int, label: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Unite the labels of linked points; x[:homes] are at home, the others ask. which: the points' places in label."""
    step = max(1, (1 << 21) // max(1, homes))
    for a in range(0, len(x), step):
        near = np.bitwise_count(x[a:a + step, None] ^ x[None, :homes]) <= bits
        i, j = np.nonzero(near)
        i, j = which[i + a], which[j]
        apart = i != j
        i, j = i[apart], j[apart]
        while len(i):
            li, lj = label[i], label[j]
            open_ = li != lj
            i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            label = _root(label)
    return label


def _unite(x: np.ndarray, homes: int, bits: int, half: Half, label: np.ndarray, which: np.ndarray, depth: int = 0) -> np.ndarray:
    if homes <= 2 * LEAF or depth > 3:
        return _brute(x, homes, bits, label, which)
    tree = Tree(x[:homes:max(1, homes // 2048)], max(1, int(math.log2(homes / LEAF))), half)
    at, leaf, home = tree.route(x, homes)
    order = np.lexsort((~home, leaf))
    at, leaf, home = at[order], leaf[order], home[order]
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(leaf)) + 1):
        n = int(home[part].sum())
        if n:
            own = at[part]
            label = _unite(x[own], n, bits, half, label, which[own], depth + 1 if n < 0.9 * homes else 4)
    return label


def shard_links(x: np.ndarray, homes: int, bits: int, half: Half) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the points of one shard, and from its queries to them."""
    label = _unite(x, homes, bits, half, np.arange(len(x)), np.arange(len(x)))
    label = _root(label)
    linked = np.flatnonzero(label != np.arange(len(x)))
    return x[linked], x[label[linked]]


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of all pairs of distinct ``fp`` within ``bits``."""
    n = nodes.count()
    leaves = max(1, n / LEAF)
    depth = min(12, max(0, math.ceil(math.log2(leaves))))
    sample = nodes.orderBy(F.xxhash64(F.lit(7), "fp")).limit(min(SAMPLE, 16 << depth)).collect() if depth else []
    sample = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    both = halves(bits)
    trees = [Tree(sample, depth, half) for half in both]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(x), 4096):
                for k, tree in enumerate(trees):
                    at, leaf, home = tree.route(x[a:a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf * 2 + k), pa.array(x[a:a + 4096][at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = shard_links(np.concatenate((x[home], x[~home])), int(home.sum()), bits, both[key[0].as_py() % 2])
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    parts = max(1, (2 << depth))
    shards = nodes.select("fp").mapInArrow(scatter, "shard long, fp long, home boolean").repartition(parts, "shard")
    return shards.groupBy("shard").applyInArrow(join, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the root of its component, from edges (a, b) with a > b."""
    edges = stored(edges.select("a", "b"), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
        # large star: greater neighbours hang below the smallest one around
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = stored(around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "star")
        # small star: a node and its smaller neighbours hang below the smallest
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(down.filter("a <> b").distinct(), "star")


def _components(nodes: DataFrame, bits: int) -> DataFrame:
    """fp, root (a fingerprint that names the component), component_id, from nodes (fp, least)."""
    tied = stars(links(nodes, bits))
    both = stored(tied.select(F.col("node").alias("fp"), "root").union(tied.select(F.col("root").alias("fp"), "root").distinct()).join(nodes, "fp"), "members")
    least = both.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stored(both.join(least, "root").select("fp", "root", "component_id"), "components")
    return nodes.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))


def near_groups(docs: DataFrame, width: int = 4, bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest identifier that links reach."""
    marks = stored(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return marks.join(_components(nodes, bits), "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """One document of each group, with the input's columns: the smallest identifier (a row without one only where the group has
    no other), of these the smallest fingerprint and hash of the text. Rows equal in identifier and text stay or go together."""
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    marks = stored(fingerprints(named, width), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    mark = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "fp", "mark")
    rows = marks.join(_components(nodes, bits).select("fp", "root"), "fp")
    first = rows.groupBy("root").agg(F.min(mark).alias("first"))
    gone = rows.join(first, "root").filter(mark != F.col("first")).select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return whole.join(gone.distinct(), F.col("doc.doc_id").cast("long").eqNullSafe(F.col("gone")) & (text_mark(F.col("doc.text")) == F.col("gone_mark")), "left_anti").select("doc.*")
