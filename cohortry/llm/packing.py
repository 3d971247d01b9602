"""Best-fit packing by a configuration linear program (operator 10).

Only the histogram of piece lengths (one count per length, at most ``limit`` of them) reaches the driver. A configuration is a
multiset of lengths that fits one sequence. The linear program over all configurations is solved in phases by multiplicative
weights. Lengths have prices; knapsack dynamic programming over the capacity gives the most valuable configuration, which turns
the prices into a lower bound on the number of sequences, and for every length the best configuration that holds it, which
joins a pool. The weights of the pool are multiplied again and again by how far their lengths are from being covered, the
prices are moved by the same multipliers, and the phase's weights are rounded to whole multiplicities that never cover a length
more often than it occurs. What remains, and pieces shorter than a sixteenth of a sequence, are packed best-fit decreasing into
the rooms left and new sequences. Phases end when the packing is proved to be within one per cent of the bound.

Pieces are then matched to places in configurations by their rank within their length, a computation per row. Ranks are counted
per (length, salt) with as many salts as the length needs, so a length that a third of the rows share is spread.

Defined results
    NULL text is an empty document of one closing id. A text longer than the limit is cut, with the short piece first. Special
    strings inside a text are encoded as the tokenizer does by default. Repeated rows are pieces of their own, and equal
    (id, piece) pairs may share or not share a sequence. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import UnitCache, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_ROWS_PER_SALT = 4096
_UNITS_PER_CALL = 256

# Unicode white space (fixed values)
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _is_plain(text: str) -> bool:
    """White space is single blanks and line feeds only, so that parts can be found by splitting at them."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER_SPACE.search("".join(set(text))))


class ByteEncoder:
    """Token ids of whole texts. A text is cut where white space follows other text, which is always the edge of a token;
    the parts are encoded by the library once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = UnitCache(self._encode, limit=300_000, chars=8_000_000)
        pieces = self.tokenizer.get_vocab()
        #: whether a token begins with a blank or a line feed, as the byte alphabet spells them
        self.begins = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.begins[[i for p, i in pieces.items() if p[:1] in ("\u0120", "\u010a")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> Iterator[bytes]:
        # a unit that does not begin with a line feed had a blank before it
        spelled = [u if u[:1] == "\n" else " " + u for u in units]
        groups = [spelled[a:a + _UNITS_PER_CALL] for a in range(0, len(units), _UNITS_PER_CALL)]
        for a in range(0, len(groups), 64):
            some = groups[a:a + 64]
            for group, ids in zip(some, self._ids(["".join(g) for g in some])):
                yield from self._apart(group, ids)

    def _apart(self, group: list[str], ids: bytes) -> list[bytes]:
        """The ids of each of some units from those of all in a row: every unit begins with its only white space."""
        edges = np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])
        if len(edges) != len(group) or edges[0] or not all(map(str.strip, group)):
            return self._ids(group)
        edges = (4 * edges).tolist() + [len(ids)]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. The new parts of all texts are encoded in one call."""
        parts = [None if _is_plain(t) else _UNIT.findall(t) for t in texts]
        plain = [None if p is not None else t.replace("\n", " \n").split(" ") for t, p in zip(texts, parts)]
        table = self.cache.table([u for p in plain if p for u in p[1:]])
        whole = [u for t, p, q in zip(texts, parts, plain) for u in (p if q is None else q[:1])]
        ids = iter(self._ids(whole))
        return [b"".join(islice(ids, len(p))) if q is None else next(ids) + b"".join(map(table.__getitem__, q[1:])) for p, q in zip(parts, plain)]


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a worker process; Spark's tasks are the parallelism, the library starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, before them the short one."""
    short = n % limit
    edges = ([0] if short else []) + list(range(short, n, limit))
    return [(a, min(n, a + limit) - a if i or not short else short) for i, a in enumerate(edges)]


def token_pieces(docs: DataFrame, path: str, limit: int = 2048, closing: int = 0, keep_ids: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids as bytes if ``keep_ids``."""
    end = np.array([closing], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                        own = ids[4 * start:4 * (start + n)]
                        rows.append((doc, k, start, n, zlib.crc32(own), own if keep_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(of, PIECES)


def price_best(price: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the highest total price that fits each room, and the place in ``sizes`` (ascending) of
    a length that a best configuration of that room takes (-1: none)."""
    best, took = np.zeros(limit + 1), np.full(limit + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(limit + 1), "right")
    for room in range(int(sizes[0]), limit + 1):
        k = fits[room]
        value = best[room - sizes[:k]] + price[:k]
        j = int(value.argmax())
        if value[j] > 0:
            best[room], took[room] = value[j], j
    return best, took


def priced_columns(price: np.ndarray, sizes: np.ndarray, limit: int, width: int) -> tuple[float, np.ndarray]:
    """(value of the best configuration, for every length the best configuration that holds it), as places in ``sizes``,
    filled with -1."""
    best, took = price_best(price, sizes, limit)
    out = np.full((len(sizes), width), -1, np.int16)
    out[:, 0] = np.arange(len(sizes))
    room = limit - sizes
    for k in range(1, width):
        j = took[room]
        out[:, k] = j
        room = room - np.where(j >= 0, sizes[np.maximum(j, 0)], 0)
    return float(best[limit]), -np.sort(-out, axis=1)


class Program:
    """The linear program: as few sequences, as shares of configurations, as cover every length as often as it occurs.

    The dual prices lengths so that no configuration is worth more than one; the value of all pieces is then a bound from below.
    ``bound`` is the best one found, over the prices tried and the volume. ``share`` has the primal multiplicities of the pool
    of configurations.
    """

    def __init__(self, sizes: np.ndarray, count: np.ndarray, limit: int, seed: int = 0):
        self.sizes, self.count, self.limit, self.rng = sizes, count.astype(float), limit, np.random.default_rng(seed)
        self.width = limit // int(sizes[0])
        self.price, self.bound = sizes / limit, 0.0
        # the parts of a sequence that a length is sure to take are prices as well, good for a bound
        for k in range(1, 16):
            steps = (k + 1) * sizes
            price = np.where(steps % limit == 0, sizes / limit, steps // limit / k) + 1e-9
            self.bound = max(self.bound, float(count @ price) / price_best(price, sizes, limit)[0][limit])
        self.pull, self.worth = np.zeros(len(sizes)), 0.0
        self.pool, self.share, self.seen = np.zeros((0, self.width), np.int16), np.zeros(0), set()

    def _try(self, price: np.ndarray) -> np.ndarray:
        value, columns = priced_columns(price, self.sizes, self.limit, self.width)
        bound = float(self.count @ price) / value
        self.bound = max(self.bound, bound)
        if bound > self.worth:
            self.worth, self.price = bound, price / value
        return columns

    def _add(self, columns: np.ndarray) -> None:
        new = [c for c in columns if (key := c.tobytes()) not in self.seen and not self.seen.add(key)]
        if new:
            start = self.share.mean() if len(self.share) else self.count.sum() / len(new)
            self.pool, self.share = np.vstack([self.pool, new]), np.append(self.share, np.full(len(new), max(start, 1e-9)))

    def phase(self, noise: float = 0.01, draws: int = 4, rounds: int = 200) -> None:
        """Price configurations into the pool, then weigh the pool multiplicatively."""
        old = self.price
        self._add(self._try(old))
        # lengths that the pool covers dearly get dearer: along their multipliers, as far as the bound gains
        top = np.abs(self.pull).max()
        if top > 0:
            for step in (0.003, 0.01, 0.03, 0.1, 0.3):
                self._add(self._try(old * np.exp(step * self.pull / top)))
        for _ in range(draws):
            self._add(self._try(self.price * (1 + noise * self.rng.random(len(self.sizes)))))
        at, place = np.nonzero(self.pool >= 0)
        item, number, n = self.pool[at, place].astype(np.int64), len(self.pool), len(self.sizes)
        own = np.bincount(at, minlength=number)
        pull = np.zeros(n)
        for _ in range(rounds):
            need = np.log(self.count / np.maximum(np.bincount(item, self.share[at], n), 1e-12))
            self.share *= np.exp(0.7 * np.bincount(at, need[item], number) / own)
            pull += need
            if np.abs(need).max() < 1e-3:
                break
        self.pull = pull - pull.mean()

    def rounded(self, more: float) -> list[tuple[dict[int, int], int]]:
        """Whole multiplicities, largest shares first, that cover no length more often than it occurs."""
        left, out = self.count.astype(np.int64), []
        times = np.floor(self.share + more).astype(np.int64)
        for c in np.argsort(-self.share, kind="stable").tolist():
            if times[c] <= 0:
                continue
            items, counts = np.unique(self.pool[c][self.pool[c] >= 0], return_counts=True)
            k = min(int(times[c]), int((left[items] // counts).min()))
            if k:
                left[items] -= k * counts
                out.append((dict(zip(self.sizes[items].tolist(), counts.tolist())), k))
        return out


@dataclass(frozen=True)
class Packing:
    """Configurations with their numbers, and what the linear program proves: no packing has fewer sequences than ``bound``."""

    configurations: list[tuple[dict[int, int], int]]
    bound: int
    phases: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def configurations(histogram: dict[int, int], limit: int, gap: float = 0.002, patience: int = 8, gain: float = 0.03) -> Packing:
    """A packing of the histogram. Best-fit decreasing gives the first upper bound; phases
    end when a packing is proved to be within ``gap`` of the least possible, or when ``patience`` of them in a row have not
    narrowed the distance between packing and bound by the share ``gain``. Both numbers are returned."""
    counts = np.zeros(limit + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    bound = -(-int(counts @ np.arange(limit + 1)) // limit)
    best = Packing(best_fit(counts, limit), bound, 0)
    # short pieces fill what the others leave; configurations have fewer than 16 lengths
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > limit // 16]
    if not len(sizes):
        return best
    program, phases, idle = Program(sizes, counts[sizes], limit), 0, 0
    while not phases or (best.sequences > bound * (1 + gap) and idle < patience):
        program.phase()
        phases += 1
        before = best.sequences - bound
        bound = max(bound, math.ceil(program.bound - 1e-6))
        for more in (0.0, 0.5, 0.999):
            whole = program.rounded(more)
            left = counts.copy()
            for config, times in whole:
                for size, c in config.items():
                    left[size] -= c * times
            found = Packing(best_fit(left, limit, whole), bound, phases)
            if found.sequences < best.sequences:
                best = found
        idle = 0 if before - (best.sequences - bound) > gain * before else idle + 1
    return Packing(best.configurations, bound, phases)


def best_fit(left: np.ndarray, limit: int, opened: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts, into the rooms of ``opened`` sequences first: equal open sequences move together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(limit + 1, np.int64)

    def put(room: int, config: dict[int, int], n: int) -> None:
        open_.setdefault(room, []).append((config, n))
        rooms[room] += n

    for config, n in opened:
        put(limit - sum(s * c for s, c in config.items()), config, n)
    for size in range(limit, 0, -1):
        n = int(left[size])
        while n:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                each = limit // size
                whole, rest = divmod(n, each)
                if whole:
                    put(limit - each * size, {size: each}, whole)
                if rest:
                    put(limit - rest * size, {size: rest}, 1)
                break
            room = size + int(fits[0])
            config, have = open_[room].pop()
            rooms[room] -= have
            times = min(n, have)
            if have > times:
                put(room, config, have - times)
            put(room - size, config | {size: config.get(size, 0) + 1}, times)
            n -= times
    return [x for group in open_.values() for x in group]


def ranked(pieces: DataFrame, histogram: dict[int, int], limit: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length."""
    salts = F.lit([1] + [max(1, -(-histogram.get(s, 0) // _ROWS_PER_SALT)) for s in range(1, limit + 1)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.get(salts, F.col("length").cast("int"))))
    salted = stored(salted, "salted")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return (salted.withColumn("inside", inside).join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "inside", "before"))


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, ids_crc32, length, and whatever else they carry)."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per length
    histogram = {int(r["length"]): int(r["n"]) for r in counts}
    rows, base, used = [], 0, np.zeros(limit + 1, np.int64)
    for config, times in configurations(histogram, limit).configurations:
        offset = 0
        for size, c in sorted(config.items(), reverse=True):
            rows.append((size, int(used[size]), c, base, offset))
            used[size] += c * times
            offset += size * c
        base += times
    rows.sort()
    table = np.array(rows or [(0, 0, 1, 0, 0)], np.int64).T
    # lengths and first ranks in one ordered key
    key = table[0] << 48 | table[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, size << 48 | rank, "right") - 1
            j, c = rank - table[1][k], table[2][k]
            yield b.drop_columns(["rank"]).append_column("sequence_id", pa.array(table[3][k] + j // c)).append_column("offset", pa.array(table[4][k] + j % c * size))
    have = ranked(pieces, histogram, limit)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in have.schema if f.name != "rank")
    return have.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids as bytes, from packed pieces that carry their ids. A sequence is bounded by the limit."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
