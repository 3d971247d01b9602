"""Quality classifier as a sparse ensemble of rules (operator 6).

Statistics of the whole text are column expressions. A small forest is grown on labelled rows; every path from a root becomes a
conjunction of thresholds, a rule. A logistic regression with lasso penalty weighs the rules, most weights become zero, and
what is left is compiled to one column expression that scores any number of documents without Python.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, drawn by a hash of the identifier; statistics and scores cover
all documents.

Defined results
    NULL text counts as empty; every rate of an empty text is 0 and it gets a score like any other. A document with several
    labels counts once for each. Rows with a NULL label teach nothing. Without labels of both kinds every score is the smoothed
    share of label 1. Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, stored, words_of

FIT_ROWS = 20_000
FEATURES = ("n_words", "word_length", "symbols", "marks", "pipes", "digits", "upper", "commas", "periods", "distinct_words", "repeated_lines", "short_lines", "longest_word")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES, all doubles."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    cut = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), words_of(text).alias("words"),
                      F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "").alias("lines"))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("double")
    raw = cut.select(
        "doc_id", F.size("words").cast("double").alias("n_words"), F.length(F.array_join("words", "")).cast("double").alias("chars"),
        left("[^#*$%&<>]+").alias("symbols"), left("[^!?]+").alias("marks"), left("[^|]+").alias("pipes"), left("[^0-9]+").alias("digits"),
        left("[^A-Z]+").alias("upper"), left("[^,]+").alias("commas"), left("[^.]+").alias("periods"),
        F.size(F.array_distinct("words")).cast("double").alias("kinds"), F.size("lines").cast("double").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("double").alias("line_kinds"),
        F.coalesce(F.array_max(F.transform("words", lambda w: F.length(w))), F.lit(0)).cast("double").alias("longest_word"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return raw.select(
        "doc_id", "n_words", per("chars", "n_words").alias("word_length"), per("symbols", "chars").alias("symbols"),
        per("marks", "n_words").alias("marks"), per("pipes", "n_words").alias("pipes"), per("digits", "chars").alias("digits"), per("upper", "chars").alias("upper"),
        per("commas", "n_words").alias("commas"), per("periods", "n_words").alias("periods"), per("kinds", "n_words").alias("distinct_words"),
        F.when(F.col("n_lines") > 0, 1 - F.col("line_kinds") / F.col("n_lines")).otherwise(F.lit(0.0)).alias("repeated_lines"),
        per("n_lines", "n_words").alias("short_lines"), "longest_word")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & (F.col(name) > at if above else F.col(name) <= at)
        return out.cast("double")


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            total = total + rule.column() * float(w)
        return 1 / (1 + F.exp(-total))


def paths(tree_text: str) -> list[Rule]:
    """All conjunctions on the way to the nodes of a printed tree, without repeated or implied terms."""
    out, stack = [], []
    for line in tree_text.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, FEATURES[int(found[3])], found[4] == ">", float(found[5])))
        tight: dict[tuple[str, bool], float] = {}
        for _, name, above, at in stack:
            key = (name, above)
            tight[key] = at if key not in tight else (max if above else min)(tight[key], at)
        out.append(Rule(tuple(sorted((n, a, t) for (n, a), t in tight.items()))))
    return out


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 17) -> Ensemble:
    """``labelled``: FEATURES and ``label`` (0.0 or 1.0)."""
    known = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = known.get(0.0, 0), known.get(1.0, 0)
    if not bad or not good:
        share = (good + 1) / (bad + good + 2)
        return Ensemble([Rule(())], [0.0], math.log(share / (1 - share)))
    rate = min(1.0, FIT_ROWS / (bad + good))
    drawn = stored(labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000).limit(2 * FIT_ROWS), "fit_rows").coalesce(8)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(drawn)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    rules = sorted(set(paths(forest.toDebugString)), key=lambda r: r.terms)
    if not rules:
        rules = [Rule(())]
    held = drawn.select("label", F.array(*[r.column() for r in rules]).alias("on"))
    logit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=200).fit(
        held.select("label", array_to_vector("on").alias("x")))
    chosen = [(r, w) for r, w in zip(rules, logit.coefficients.toArray().tolist()) if w]
    return Ensemble([r for r, _ in chosen], [w for _, w in chosen], float(logit.intercept))
