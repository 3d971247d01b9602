"""Quality rules with risk-controlled thresholds (operator 3).

Each document gets plain statistics of its whole text. A rule rejects a document whose rate lies above a cutoff. The
cutoffs are chosen per stratum from labelled holdout documents: one sequence of cutoffs of all rules together, fixed
beforehand and from lenient to strict, is tested step by step. A step is certified if an exact binomial test at level
``delta / strata`` shows that its rules together reject at most the share ``alpha`` of good documents (the one-sided
Clopper-Pearson bound lies below that share). Testing stops at the first step that fails (fixed-sequence testing),
Bonferroni holds over strata only. So, with probability ``1 - delta``, at most the share ``alpha`` of the good documents
of any stratum is rejected. Strata with too few good labels for any step are tested as one pool; there the share holds for
the pool as a whole. A stratum without good labels, or where the first step fails, has the base rules only.

Everything is DataFrame functions. The labelled counts shrink to one row per stratum before anything is windowed.

Defined results
    NULL text has no words. NULL language is a stratum of its own. Documents without words have rate 0 and fail the
    base rules. A document with several labels is good if any of them says 1. Repeated rows are judged alike. Windows are
    compared by 64-bit hashes within one text. Empty tables, and no labels at all, leave only the base rules.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import BLANKS, stored, words_of

WINDOW = 8


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    cut = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.lit("all") if stratum is None else stratum).alias("stratum"),
                      text.alias("text"), words_of(text).alias("words"),
                      F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "").alias("lines"))
    # every array is used more than once below, so that the optimiser keeps it as a column
    runs = cut.select("doc_id", "stratum", "text", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
                      F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                      F.when(F.size("words") >= WINDOW, F.transform(
                          F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("runs"))
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    placed = runs.withColumn("placed", F.when(again, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    before = lambda k: F.get("placed", k - 1)["h"]
    after = lambda k: F.get("placed", k + 1)["h"]
    found = F.array_sort(F.transform(
        F.filter("placed", lambda e, k: F.coalesce(e["h"] == before(k), F.lit(False)) | F.coalesce(e["h"] == after(k), F.lit(False))),
        lambda e: e["i"]))
    covered = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")))["n"]
    count = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return placed.select(
        "doc_id", "stratum", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars")],
        count(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        count("[^A-Z]+").cast("long").alias("n_upper"), count("[^!?]+").cast("long").alias("n_marks"))


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose rate is above a cutoff; candidates are given from lenient to strict."""

    name: str
    over: str
    under: str
    cutoffs: tuple[float, ...]

    def rate(self) -> Column:
        return F.when(F.col(self.under) > 0, F.col(self.over) / F.col(self.under)).otherwise(F.lit(0.0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    Rule("repeats", "n_repeat_words", "n_words", (0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    Rule("upper", "n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08)),
    Rule("marks", "n_marks", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("long_words", "word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
)


def risk_is_below(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Exact test: at most ``k`` failures in ``n`` trials have a chance of at most ``level`` if the true share is ``risk``.

    The tail is summed downwards from ``k`` in units of the chance of ``k``, whose logarithm is a sum, so it cannot underflow.
    """
    odds = (1 - risk) / risk
    log_k = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0),
                        lambda a, i: a + F.ln((n - i + 1).cast("double") / i)) + k * math.log(risk) + (n - k) * math.log(1 - risk)
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")),
                       F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
                       lambda a, i: F.struct((a["sum"] + a["term"] * (k - i) * odds / (n - (k - i) + 1)).alias("sum"),
                                             (a["term"] * (k - i) * odds / (n - (k - i) + 1)).alias("term")))["sum"]
    return F.when(k >= n * risk, F.lit(False)).otherwise(log_k + F.ln(tail) <= F.ln(level))


def steps(rules: Sequence[Rule] = RULES) -> list[tuple[float, ...]]:
    """The cutoffs of all rules together, from lenient to strict; a rule with fewer candidates repeats some."""
    n = max((len(r.cutoffs) for r in rules), default=0)
    return [tuple(float(r.cutoffs[j * len(r.cutoffs) // n]) for r in rules) for j in range(n)]


def least_labels(strata: int, alpha: float = 0.03, delta: float = 0.05) -> int:
    """The fewest good labels with which a step that rejects none of them is certified at level ``delta / strata``."""
    return math.ceil(math.log(delta / strata) / math.log(1 - alpha))


def certified_cutoffs(good: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, pooled, n, k, one column per rule) from the statistics of good documents that pass the base rules.

    n, k: the good labels that the last certified step was tested on, and how many of them it rejects. Strata without a
    certified step are absent.
    """
    path = steps(rules)
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(reduce(operator.or_, [r.rate() > c for r, c in zip(rules, cuts)]).cast("long")).alias(f"k_{j}") for j, cuts in enumerate(path)])
    counts = stored(counts, "label_counts")
    least = least_labels(max(1, counts.count()), alpha, delta)
    pooled = F.col("n") < least
    counts = counts.select("stratum", pooled.alias("pooled"), F.when(pooled, F.lit("")).otherwise(F.concat(F.lit("="), "stratum")).alias("part"),
                           "n", *[f"k_{j}" for j in range(len(path))])
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), *[F.sum(f"k_{j}").alias(f"k_{j}") for j in range(len(path))])
    level = delta / max(1, parts.count())
    tests = parts.select("part", "n", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col(f"k_{j}").alias("k"), *[F.lit(c).alias(f"cut_{r.name}") for r, c in zip(rules, cuts)])
        for j, cuts in enumerate(path)])).alias("t")).select("part", "n", "t.*")
    so_far = Window.partitionBy("part").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    passes = risk_is_below(F.col("k"), F.col("n"), alpha, F.lit(level))
    held = tests.withColumn("all", F.min(passes.cast("int")).over(so_far)).filter(F.col("all") == 1)
    names = ["n", "k", *[f"cut_{r.name}" for r in rules]]
    last = held.groupBy("part").agg(F.max_by(F.struct(*names), "j").alias("last"))
    return counts.select("stratum", "pooled", "part").join(last, "part").select("stratum", "pooled", *[f"last.{c}" for c in names])


def judge(stats: DataFrame, good_ids: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """The statistics with base_failed, kept, and the name of the first rule that rejected. ``good_ids``: doc_id of good holdouts."""
    good = stats.filter(~base_failed()).join(good_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    cuts = stored(certified_cutoffs(good, rules, alpha, delta).drop("pooled", "n", "k"), "cutoffs")  # one row per stratum
    over = F.coalesce(*[F.when(r.rate() > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules])
    return (stats.join(cuts, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("rejected_by", over)
            .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()))


def language_stratum(docs: DataFrame, lang_col: str = "lang") -> Column:
    lang = docs[lang_col].cast("string")
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang))


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the input's columns. Rows that share an identifier are judged together: all must pass."""
    stats = stored(base_statistics(docs, stratum=language_stratum(docs)), "statistics")
    gone = judge(stats, good_labels(labels)).filter("NOT kept").select(F.struct(F.col("doc_id")).alias("gone"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    key = F.struct(F.col("doc.doc_id").cast("long"))
    return whole.join(gone.distinct(), key.eqNullSafe(F.col("gone")), "left_anti").select("doc.*")
