"""Prediction of held-out outcomes and feature attribution (I1-I5, I8-I10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import few_parts
from ..functions.columns import col, is_true, safe_numeric
from ..functions.ranks import exact_quantiles, lowest_k, stable_key, tally, with_ranks
from ..functions.sizes import one_row
from . import boosting, forest


def quantile_label(df: DataFrame, column: str, out: str, share: float = 0.25, drop_missing: bool = False) -> DataFrame:
    """Add 1 where the value is at or under its ``share`` quantile, else 0.

    A missing value counts as 0; with ``drop_missing`` its row is left out instead.
    """
    value = safe_numeric(col(column))
    cut = exact_quantiles(df, {"q": (col(column), [share])})["q"][0]
    src = df.filter(value.isNotNull()) if drop_missing else df
    hit = F.lit(False) if cut is None else is_true(value <= F.lit(cut))
    return src.select("*", hit.cast("int").alias(out))


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = 42,
                     out: str = "is_test", **rank_options) -> DataFrame:
    """Add a 0/1 column with exactly ``round(test_share * n)`` test rows per class.

    Rows are chosen by a hash of their id, so the split is the same on any cluster; equal
    hashes are settled by the id, and rows with the same id stay together. Only (class, hash, id) is shuffled, in value ranges where a
    class is large, and gives one cut per class; the cuts are joined to the rows. Rows
    without a class are a class of their own.
    """
    # a missing class has a text as well
    name, key = F.to_json(F.struct(col(label).alias("y"))), stable_key(col(id_col), seed)
    keyed = df.select(name.alias("y"), key.alias("k"), col(id_col).alias("t"), F.lit(1).cast("long").alias("n"))
    take = keyed.groupBy("y").agg(F.floor(test_share * F.count(F.lit(1)) + 0.5).alias("take"))
    ranked = with_ranks(keyed, "k", ["y"], before="__before", **rank_options).join(take, "y")
    place = F.col("__before") + F.row_number().over(W.partitionBy("y", "k").orderBy("t"))
    cuts = (ranked.withColumn("__place", place).filter(F.col("__place") <= F.col("take"))
            .groupBy(F.col("y").alias("__y")).agg(F.max(F.struct("k", "t")).alias("__cut")))
    mine = F.struct(key.alias("k"), col(id_col).alias("t")) <= F.col("__cut")
    return df.join(cuts, name == F.col("__y"), "left").select(*[col(c) for c in df.columns], is_true(mine).cast("int").alias(out))


def train_classifiers(train: DataFrame, label: str = "label", features: str = "features", multiclass: bool = False,
                      trees: int = 300, rounds: int = 300, depth: int = 4, rate: float = 0.05,
                      row_share: float = 0.8, column_share: float = 0.8, forest_depth: int = 30, penalty: float = 1.0,
                      seed: int = 42, models: Sequence[str] = ("LR", "RF", "GBT")) -> dict:
    """Fitted models by name: logistic regression, a forest, and boosted trees with a softmax over the classes.

    ``penalty`` weighs half the squared coefficients against the sum of the losses of all rows. Forests grow 30 levels
    deep and are kept in a table; boosting draws its rows per round and its columns per tree. Rows without a label or a vector teach nothing.
    """
    known = train.filter(safe_numeric(col(label)).isNotNull() & col(features).isNotNull())
    few = few_parts(known)  # every iteration goes through the rows
    makers = {
        # Spark takes the mean of the losses
        "LR": lambda: LogisticRegression(maxIter=2000, regParam=penalty / max(1, known.count()), standardization=False,
                                         featuresCol=features, labelCol=label).fit(few),
        "RF": lambda: forest.fit(known, label, features, trees, forest_depth, seed=seed),
        "GBT": lambda: boosting.boost(train, label, features, rounds, depth, rate, row_share, column_share, seed=seed),
    }
    return {m: makers[m]() for m in models}


def auc_by_ranks(df: DataFrame, positive: str, score: str, by: Sequence[str] = (), **rank_options) -> DataFrame:
    """(by..., auc): Mann-Whitney with average ranks over tallies of equal scores."""
    by = list(by)
    cells = tally(df, *by, score, positive)
    ranked = with_ranks(cells, score, by, rank="__r", rows=df, **rank_options)
    pos, n = F.col(positive) == 1, F.col("n").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.when(pos, n * F.col("__r"))).alias("r"),
        F.sum(F.when(pos, n).otherwise(0.0)).alias("p"), F.sum(F.when(~pos, n).otherwise(0.0)).alias("q"))
    p, q = F.col("p"), F.col("q")
    return sums.select(*by, ((F.col("r") - p * (p + 1.0) / 2.0) / F.nullif(p * q, F.lit(0.0))).alias("auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary_metrics(df: DataFrame, y: str, predicted: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, f1, precision, recall, auc); a ratio without a base is 0."""
    by = list(by)
    src = df.select(*[col(b) for b in by], col(y).cast("int").alias("y"), col(predicted).cast("int").alias("yhat"),
                    col(score).cast("double").alias("score"))
    # one tally feeds the counts and the ranks
    cells = src.groupBy(*by, "score", "y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("yhat") == 1).alias("hot"))
    ranked = with_ranks(cells, "score", by, rank="r", rows=src)
    pos = F.col("y") == 1
    s = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(pos, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(pos, F.col("hot")).otherwise(0)).alias("tp"), F.sum("hot").alias("hot"),
        F.sum(F.when(pos, F.col("n") * F.col("r"))).alias("rank_sum"))
    n, p, tp, hot = (F.col(c) for c in ("n", "p", "tp", "hot"))
    q = n - p
    auc = (F.col("rank_sum") - p.cast("double") * (p + 1) / 2.0) / F.nullif(p.cast("double") * q, F.lit(0.0))
    return s.select(*by, "n", ((n - p - hot + 2 * tp) / n).alias("accuracy"), _ratio(2 * tp, p + hot).alias("f1"),
                    _ratio(tp, hot).alias("precision"), _ratio(tp, p).alias("recall"), auc.alias("auc"))


def multiclass_metrics(df: DataFrame, y: str, predicted: str, scores: Mapping[object, Column] | None = None) -> DataFrame:
    """(n, accuracy, f1_macro, balanced_acc, auc_ovr). ``scores`` maps each class to its score column."""
    src = df.select(col(y).alias("y"), col(predicted).alias("yhat"),
                    *[v.cast("double").alias(f"s{i}") for i, v in enumerate((scores or {}).values())])
    confusion = src.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    # the confusion table is small; each cell adds to its true and to its predicted class
    sides = confusion.select("n", F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred"), (F.col("y") == F.col("yhat")).cast("int").alias("hit")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))))
    per = sides.groupBy("c").agg(F.sum(F.col("n") * F.col("is_true")).alias("t"),
                                 F.sum(F.col("n") * F.col("is_pred")).alias("p"), F.sum(F.col("n") * F.col("hit")).alias("tp"))
    out = per.agg(F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"),
                  F.avg(_ratio(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("f1_macro"),
                  F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("balanced_acc"))
    if not scores:
        return out
    long = src.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("class"), (F.col("y") == F.lit(c)).cast("int").alias("pos"), F.col(f"s{i}").alias("score"))
        for i, c in enumerate(scores)])))
    auc = auc_by_ranks(long, "pos", "score", ["class"]).agg(F.avg("auc").alias("auc_ovr"))
    # two one-row results side by side
    both = out.unionByName(auc, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- attribution -------------------------------------------------------------------

def linear_attribution(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(feature, mean_abs): mean |w (x - mean x)|, the exact Shapley values of a linear model."""
    columns = list(weights)
    mean = one_row(df.agg(*[F.avg(safe_numeric(col(c))).alias(f"m{i}") for i, c in enumerate(columns)]))
    wide = df.agg(*[F.avg(F.abs(F.lit(float(weights[c])) * (safe_numeric(col(c)) - F.lit(mean[f"m{i}"])))).alias(f"a{i}")
                    for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs")) for i, c in enumerate(columns)]))) \
        .orderBy(F.desc("mean_abs"), "feature")


def model_attribution(df: DataFrame, model, features: Sequence[str], vec: str = "features") -> DataFrame:
    """(feature, mean_abs) of a fitted linear classifier.

    |w (x - mean)| = |w| |x - mean|, so one pass for the means and one for the mean
    absolute deviations serve every class; classes are averaged after the absolute value.
    """
    mean = one_row(df.agg(Summarizer.mean(F.col(vec)).alias("m")))["m"].toArray()
    centre = F.lit([float(x) for x in mean])
    away = array_to_vector(F.zip_with(vector_to_array(F.col(vec)), centre, lambda x, m: x - m))
    row = one_row(df.agg(Summarizer.metrics("normL1", "count").summary(away).alias("s")))["s"]
    deviation = row["normL1"].toArray() / row["count"]
    weight = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return _ranking(df, features, weight * deviation)


def _ranking(df: DataFrame, features: Sequence[str], values) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, mean_abs double").orderBy(F.desc("mean_abs"), "feature")


def permuted(df: DataFrame, id_col: str, vec: str, seed: int = 42) -> DataFrame:
    """(id, v, donor): every row with the vector of another row, a random permutation of the table.

    Two hash orders of the ids are matched rank by rank; the ranks are counted in value
    ranges, so the permutation needs no global sort in one task.
    """
    rows = df.select(col(id_col).alias("id"), vector_to_array(col(vec)).alias("v"))
    place = lambda salt: with_ranks(
        rows.select("id", stable_key(F.col("id"), seed, salt).alias("key"), F.lit(1).cast("long").alias("n")),
        "key", rank="r").withColumn("r", F.col("r") * 2).select("id", F.col("r").cast("long").alias("r"))
    # equal keys share a rank; the few such rows keep each other's vectors in id order
    order = W.partitionBy("r").orderBy("id")
    here = place("a").withColumn("t", F.row_number().over(order))
    there = place("b").withColumn("t", F.row_number().over(order)).withColumnRenamed("id", "donor_id")
    pairs = here.join(there, ["r", "t"], "left").select("id", F.coalesce("donor_id", "id").alias("donor_id"))
    donors = rows.select(F.col("id").alias("donor_id"), F.col("v").alias("donor"))
    return rows.join(pairs, "id").join(donors, "donor_id").select("id", "v", "donor")


def permutation_attribution(df: DataFrame, model, id_col: str, features: Sequence[str], vec: str = "features",
                            sample: int | None = None, seed: int = 42) -> DataFrame:
    """(feature, mean_abs): mean absolute change of the predicted probabilities when one feature is
    swapped with another row's, on all rows, or on ``sample`` of them where that is asked for. For tree models."""
    src = df
    if sample is not None and df.count() > sample:
        src = df.filter(lowest_k(df, stable_key(col(id_col), seed), col(id_col), {None: sample}))
    pairs = permuted(src, id_col, vec, seed)
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "j int, feature string")
    if isinstance(model, forest.Forest):
        means = model.swapped(pairs).select("j", (F.col("total") / F.col("n")).alias("mean_abs"))
        return names.join(means, "j").select("feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")
    n = len(features)
    swapped = pairs.select("id", "v", "donor", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select(
        "j", array_to_vector("v").alias("__v"),
        array_to_vector(F.transform("v", lambda x, i: F.when(i == F.col("j"), F.col("donor")[i]).otherwise(x))).alias(vec))
    probability = lambda frame, out: model.transform(frame).withColumn(out, vector_to_array("probability")).drop(
        "rawPrediction", "probability", "prediction")
    after = probability(swapped, "__after").drop(vec).withColumnRenamed("__v", vec)
    change = F.aggregate(F.zip_with("__after", "__before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) \
        / F.size("__after")
    means = probability(after, "__before").groupBy("j").agg(F.avg(change).alias("mean_abs"))
    return names.join(means, "j").select("feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def leakage_sensitivity(full: DataFrame, reduced: DataFrame, top: int = 20, value: str = "mean_abs") -> DataFrame:
    """(overlap, jaccard) of the ``top`` features of two rankings."""
    best = lambda d, mark: d.orderBy(F.desc(value), "feature").limit(top).select("feature", F.lit(mark).alias("m"))
    # both lists are top-k reports
    seen = best(full, 1).unionByName(best(reduced, 2)).groupBy("feature").agg(F.count(F.lit(1)).alias("lists"))
    return seen.agg(F.count_if(F.col("lists") == 2).alias("overlap"), F.count(F.lit(1)).alias("union_size")).select(
        "overlap", (F.col("overlap") / F.greatest("union_size", F.lit(1))).alias("jaccard"))


def attribution_direction(df: DataFrame, pairs: Mapping[str, str], top: int = 10) -> DataFrame:
    """(feature, corr, direction) of each feature with its contribution column, all in one pass.

    ``pairs`` maps a feature column to its contribution column; the ``top`` features by mean
    absolute contribution are kept. A constant side has no correlation and counts negative.
    """
    wide = df.agg(*[x for i, (f, c) in enumerate(pairs.items()) for x in (
        F.corr(safe_numeric(col(f)), safe_numeric(col(c))).alias(f"r{i}"),
        F.avg(F.abs(safe_numeric(col(c)))).alias(f"a{i}"))])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("corr"), F.col(f"a{i}").alias("mean_abs"))
        for i, f in enumerate(pairs)])))
    return long.orderBy(F.desc("mean_abs"), "feature").limit(top).select(
        "feature", "corr", F.when(is_true(F.col("corr") >= 0), "positive").otherwise("negative").alias("direction"))


def linear_contributions(df: DataFrame, id_col: str, weights: Mapping[str, float]) -> DataFrame:
    """(id, feature, value, contribution) per row: weight times the distance of the value from its mean; no row for a missing value."""
    means = df.agg(*[F.avg(safe_numeric(col(c))).alias(f"m{i}") for i, c in enumerate(weights)]).first()  # one row
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), safe_numeric(col(c)).alias("value"),
                               (F.lit(float(w)) * (safe_numeric(col(c)) - F.lit(means[i]))).alias("contribution"))
                      for i, (c, w) in enumerate(weights.items())])
    return df.select(col(id_col), F.inline(cells)).filter("value IS NOT NULL")


def contribution_direction(contributions: DataFrame, top: int = 10) -> DataFrame:
    """(feature, corr, direction) of the ``top`` features by mean absolute contribution, from ``linear_contributions``."""
    each = contributions.groupBy("feature").agg(F.corr("value", "contribution").alias("corr"), F.avg(F.abs("contribution")).alias("mean_abs"))
    return each.orderBy(F.desc("mean_abs"), "feature").limit(top).select(
        "feature", "corr", F.when(is_true(F.col("corr") >= 0), "positive").otherwise("negative").alias("direction"))
