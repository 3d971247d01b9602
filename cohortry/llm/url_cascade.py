"""URL filter by a cascade of Bloom filters (operator 2).

A rule is a host and a path beginning, like ``example.com/en/``; it fits the host and its subdomains. The keys that could fit a
URL are its host's endings at dots, joined with the beginnings of its path that are as long as some rule's. Level 1 of a
cascade encodes the listed keys. Level 2 encodes those keys of the corpus that are not listed but pass level 1, level 3 the
listed keys that pass level 2, and so on, until no key is wrong. A key is then a member if the first level that it does not
pass is even (or, if it passes all, if their number is odd): exact for every listed key and every key of the corpus, with no
join. There is one cascade of blocked and one of allowed keys; the longest member decides.

Levels hold bits in proportion to the listed keys; they are built by aggregating the words of the bit array, and their size is
checked against ``MAX_BYTES`` before they are shipped to the tasks.

Defined results
    NULL URLs, and such without ``://``, have an empty host and path, fit no rule and get the default verdict. The longest rule
    (host and path together) decides; of equally long ones the one with the longer host. A key that is listed as both allowed
    and blocked is blocked. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

MAX_BYTES = 64 << 20
_HASHES = 4
_LEVELS = 64


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int], labels: Sequence[int]) -> Column:
    """Every (host ending, path beginning) that a rule could name; ``lengths`` are those of the rules' paths, ``labels`` the
    numbers of labels of their hosts, so a host of very many labels has no more endings than any other."""
    parts = F.split(host, r"\.", -1)
    endings = F.filter(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(labels)]), lambda h: h.isNotNull())
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]), lambda p: p.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(endings, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))


def _mix(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Places of keys with hashes a, b in the bit array of a level: one row per hash function."""
    x = a.view(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    y = b.view(np.uint64) | np.uint64(1)
    out = []
    for i in range(_HASHES):
        z = x + y * np.uint64(i + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append((z ^ (z >> np.uint64(31))) % np.uint64(bits))
    return np.array(out)


@dataclass
class Level:
    bits: int
    words: np.ndarray

    def has(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        at = _mix(a, b, level, self.bits)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[level.has(p["a"].to_numpy(np.int64), p["b"].to_numpy(np.int64), number)]
    return keys.mapInPandas(keep, keys.schema)


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A Bloom filter of ``n`` keys: each task emits the words it sets, and they are united per word."""
    each = 1 / -math.log1p(-rate ** (1 / _HASHES)) * _HASHES
    bits = max(256, 64 * math.ceil(n * each / 64))
    if bits // 8 > MAX_BYTES:
        raise ValueError(f"a level of {bits // 8} bytes is too large to ship; raise MAX_BYTES or split the list")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at = _mix(p["a"].to_numpy(np.int64), p["b"].to_numpy(np.int64), number, bits).ravel()
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "set": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})
    found = keys.mapInPandas(words, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, out)


@dataclass
class Cascade:
    levels: list[Level]

    def members(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for listed keys and for the keys of the corpus the cascade was built over."""
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for i, level in enumerate(self.levels):
            passes = level.has(a[open_], b[open_], i)
            out[open_[~passes]] = i % 2 == 1
            open_ = open_[passes]
        out[open_] = len(self.levels) % 2 == 1
        return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed``: keys of the list. ``universe``: distinct keys of the whole corpus (listed ones among them do no harm)."""
    inside = stored(_hashed(listed.distinct()), "listed")
    outside = stored(_hashed(universe.join(inside.select("key"), "key", "left_anti")), "universe")
    n, others = inside.count(), outside.count()
    levels: list[Level] = []
    mine, theirs = inside, outside
    # level 1 lets about as many strangers through as there are listed keys; later ones half of what is left
    rate = min(0.5, max(1e-9, n / math.sqrt(2) / max(1, others)))
    while n:
        if len(levels) == _LEVELS:
            raise ValueError("two keys share both hashes")
        levels.append(_level(mine, n, rate, len(levels)))
        wrong = stored(_passing(theirs, levels[-1], len(levels) - 1), "wrong")
        mine, theirs, rate = wrong, mine, 0.5
        n = wrong.count()
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules``: (verdict, host and path) with verdict ``allow`` or ``block``."""
    spark = pages.sparkSession
    blocked = {r for v, r in rules if v == "block"}
    allowed = {r for v, r in rules if v == "allow"} - blocked
    lengths = {len(r) - r.index("/") for r in blocked | allowed}
    labels = {r[:r.index("/")].count(".") + 1 for r in blocked | allowed}
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    universe = stored(urls.select(F.explode("keys").alias("key")).distinct(), "keys")
    listed = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    block, allow = build(listed(blocked), universe), build(listed(allowed), universe)

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n = p["a"].map(len).to_numpy()
            whole = lambda c: np.concatenate(p[c].to_numpy()).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
            a, b = whole("a"), whole("b")
            said = np.where(block.members(a, b), 2, np.where(allow.members(a, b), 1, 0)).astype(np.int32)
            yield p.drop(columns=["a", "b"]).assign(said=np.split(said, np.cumsum(n)[:-1]))
    hashed = urls.withColumns({"a": F.transform("keys", lambda k: F.xxhash64(k)), "b": F.transform("keys", lambda k: F.xxhash64(F.lit(1), k))})
    held = hashed.select("page_id", "host", "path", "keys", "a", "b").mapInPandas(
        verdicts, f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, keys array<string>, said array<int>")
    best = F.array_max(F.filter(F.transform("keys", lambda k, i: F.struct(
        F.when(F.col("said")[i] > 0, F.length(k)).alias("n"), F.instr(k, "/").alias("host"), k.alias("rule"), F.col("said")[i].alias("said"))),
        lambda s: s["n"].isNotNull()))
    return held.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.said") == 2, "block").when(F.col("best.said") == 1, "allow").otherwise(default).alias("verdict"))
