"""Language identification by nearest centroids (operator 4).

A text is a TF-IDF vector of its hashed byte trigrams, of length one. Document frequencies are counted over all training
documents. Each language has several centroids, found by spherical k-means on a bounded sample of its training documents: the
distinct texts of its lowest hashes, ``SAMPLE_ROWS`` over all languages, at most ``PER_LANGUAGE`` and at least one of each. A text gets the language of the
centroid with the largest cosine. It is rejected as none of them when its cosine lies below the centroid's floor, a low
quantile of the cosines of the centroid's own training texts; the nearest language is still returned beside that.

Defined results
    NULL texts and texts without a letter are ``und`` with score 0. Without a training document every text is ``und``. Equal
    cosines go to the language that sorts first. Repeated rows are predicted alike; an empty table gives an empty result. Only
    text is read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SIZE = 4096
SAMPLE_ROWS = 2048
PER_LANGUAGE = 400
CENTROIDS = 4
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of the lower-cased letters, a blank at either end."""
    b = b" " + b" ".join((text or "").lower().encode().translate(_KEEP).split()) + b" "
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(SIZE, np.int64)
    code = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
    return np.bincount((code >> np.uint32(20)).astype(np.int64), minlength=SIZE)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), SIZE), np.float32)
    for i, t in enumerate(texts):
        n = trigrams(t)
        at = np.flatnonzero(n)
        x[i, at] = (1 + np.log(n[at])) * idf[at]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; starts with points far from each other."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(20):
        own = (x @ c.T).argmax(axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c.astype(np.float32)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 3, floor: float = 0.005) -> Model | None:
    """Learn from texts and their languages; None without any."""
    rows = train.select(train[text_col].cast("string").alias("text"), train[lang_col].cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += trigrams(t.as_py()) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["term", "n"])
    # SIZE + 1 rows, whatever the corpus
    counted = rows.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SIZE + 1)
    for r in counted:
        df[r["term"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    # copies of one text count once; every language teaches, from its texts of the lowest hashes
    distinct = stored(hashed.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")).select("lang", "hash"), "hashes")
    known = distinct.select("lang").distinct().count()
    if not known:
        return None
    each = min(PER_LANGUAGE, max(1, SAMPLE_ROWS // known))
    lowest = distinct.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("place") <= each).drop("place")
    # at most ``each`` rows of every language that the model will hold: small enough for every task
    drawn = hashed.join(F.broadcast(lowest), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]).select("lang", "text", "hash")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(1).to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "hash", "x"])
    # at most ``each`` rows a language
    sample = sorted(drawn.mapInArrow(embed, "lang string, hash long, x binary").collect(), key=lambda r: (r["lang"], r["hash"]))
    languages, owner, centroids, floors = sorted({r["lang"] for r in sample}), [], [], []
    for k, lang in enumerate(languages):
        x = np.array([np.frombuffer(r["x"], np.float32) for r in sample if r["lang"] == lang])
        c = _k_means(x, CENTROIDS, seed)
        near = (x @ c.T).max(axis=1)
        mine = (x @ c.T).argmax(axis=1)
        owner += [k] * len(c)
        centroids.append(c)
        floors += [float(np.quantile(near[mine == j], floor)) if (mine == j).any() else 0.0 for j in range(len(c))]
    return Model(idf, languages, np.array(owner), np.vstack(centroids), np.array(floors))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected (nearer to none than its own texts are)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if model is not None:
                    cos = vectors(texts, model.idf) @ model.centroids.T
                    best = cos.argmax(axis=1)
                    near = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(float)
                    for i, t in enumerate(texts):
                        if has_letter(t):
                            lang[i], score[i], far[i] = model.languages[model.owner[best[i]]], near[i], near[i] < model.floor[best[i]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        of, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(crc: Column) -> Column:
    return F.pmod(crc, F.lit(4)) == 2
