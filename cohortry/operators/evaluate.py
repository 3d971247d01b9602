"""Cluster evaluation and selection (G1-G18)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, melt, safe_numeric
from ..functions.ranks import lowest_k, stable_key, tally, value_ranks
from ..functions.sizes import broadcast_if_small
from ..functions.vectors import as_stored, block_pairs, doubles, squared_distance, stack

#: clusters one labeling may have when its summary is brought to a broadcast
MAX_CLUSTERS = 10_000


# --- geometry ---------------------------------------------------------------------

def silhouette_rows(df: DataFrame, id_col: str, vec: str, labels: Sequence[str],
                    block_rows: int = 2048) -> DataFrame:
    """(labeling, id, own_label, silhouette) with Euclidean distances over all rows.

    Distances are needed between all rows, so the work is quadratic by definition. It
    is cut into block pairs; those of a block are reduced to one distance sum per row and cluster
    before anything is shuffled, and several labelings share the same distances. A row
    without a label takes no part in that labeling, one without a vector in none.
    """
    names = list(labels)
    rows = df.select(col(id_col).alias("id"), doubles(col(vec)).alias("v"),
                     *[col(c).cast("string").alias(f"l{i}") for i, c in enumerate(names)]).filter("v IS NOT NULL")

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b, own, others = stack(x["v"]), stack(y["v"]), x["id"].to_numpy(), y["id"].to_numpy()
        dist = a @ b.T
        dist *= -2.0
        dist += (a * a).sum(1)[:, None]
        dist += (b * b).sum(1)[None, :]
        if len(np.intersect1d(own, others)):
            dist[own[:, None] == others[None, :]] = 0.0
        np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
        # a column per cluster of every labeling; rows without a label are in none
        coded = [pd.factorize(y[f"l{i}"]) for i in range(len(names))]
        hot = np.hstack([(codes[:, None] == np.arange(len(found))).astype(float) for codes, found in coded])
        total, counts, out, at = dist @ hot, hot.sum(axis=0), [], 0
        for i, (name, (_, found)) in enumerate(zip(names, coded)):
            mine, cut = x[f"l{i}"].notna().to_numpy(), slice(at, at + len(found))
            at += len(found)
            out.append(pd.DataFrame({
                "labeling": name, "id": np.repeat(own[mine], len(found)), "own": np.repeat(x[f"l{i}"].to_numpy()[mine], len(found)),
                "other": np.tile(np.asarray(found), int(mine.sum())), "s": total[mine, cut].ravel(),
                "n": np.tile(counts[cut].astype(np.int64), int(mine.sum()))}))
        return pd.concat(out, ignore_index=True)

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.groupby(["labeling", "id", "own", "other"], dropna=False, sort=False, as_index=False).sum()

    id_type = rows.schema["id"].dataType.simpleString()
    partial = block_pairs(rows, rows, "id", "id", sums,
                          f"labeling string, id {id_type}, own string, other string, s double, n long", block_rows, added)
    per_cluster = partial.groupBy("labeling", "id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("other")
    ab = per_cluster.groupBy("labeling", "id", "own").agg(
        F.max(F.when(mine, F.col("n"))).alias("size"),
        F.max(F.when(mine, F.col("s") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    spread = F.greatest("a", "b")
    score = F.when((F.col("size") == 1) | (spread == 0) | F.col("b").isNull(), 0.0) \
        .otherwise((F.col("b") - F.col("a")) / spread)
    return ab.select("labeling", "id", F.col("own").alias("own_label"), score.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec: str, labels: Sequence[str] | str, mode: str = "exact",
               sample: int | None = None, seed: int = 42, block_rows: int = 2048) -> DataFrame:
    """(labeling, silhouette), the mean over rows.

    ``exact``: Euclidean over all rows. ``sample``: the same on ``sample`` rows drawn by a
    stable hash. ``squared``: Spark's linear-time evaluator on squared distances, which is
    a different number and for tables too large for the others.
    """
    names = [labels] if isinstance(labels, str) else list(labels)
    if mode == "squared":
        rows = []
        for c in names:
            ready = df.filter(col(vec).isNotNull() & col(c).isNotNull()).select(
                array_to_vector(doubles(col(vec))).alias("features"), col(c).cast("string").alias("text"))
            # the evaluator wants numbers and keeps the sums of all clusters in a broadcast anyway
            coded = StringIndexer(inputCol="text", outputCol="prediction").fit(ready).transform(ready)
            rows.append((c, ClusteringEvaluator(featuresCol="features").evaluate(coded)))
        return df.sparkSession.createDataFrame(rows, "labeling string, silhouette double")
    if mode == "sample":
        df = df.filter(lowest_k(df, stable_key(col(id_col), seed), col(id_col), {None: sample}))
    return silhouette_rows(df, id_col, vec, names, block_rows).groupBy("labeling").agg(
        F.avg("silhouette").alias("silhouette"))


def cluster_centres(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n, centre, within): one pass, vectors are summarised on the map side.

    ``within`` is the sum of squared distances to the centre.
    """
    ready = df.select(*[col(b) for b in by], col(label).alias("label"),
                      array_to_vector(doubles(col(vec))).alias("__v"))
    summary = ready.groupBy(*by, "label").agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("__v")).alias("s"))
    variance = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda s, x: s + x)
    return summary.select(*by, "label", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("centre"),
                          (variance * (F.col("s.count") - 1)).alias("within"))


def calinski_harabasz(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., calinski_harabasz): between over within dispersion per degree of freedom."""
    by = list(by)
    centres = broadcast_if_small(cluster_centres(df, vec, label, by), MAX_CLUSTERS)
    dims = centres.select(*by, "label", "n", "within", F.posexplode("centre").alias("pos", "x"))
    per_dim = W.partitionBy(*by, "pos")
    grand = F.sum(F.col("n") * F.col("x")).over(per_dim) / F.sum("n").over(per_dim)
    away = dims.select(*by, "label", "n", "within", F.pow(F.col("x") - grand, 2).alias("d")) \
        .groupBy(*by, "label", "n", "within").agg(F.sum("d").alias("d"))
    sums = away.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"),
                                 F.sum("within").alias("within"), F.sum(F.col("n") * F.col("d")).alias("between"))
    value = F.when(F.col("within") == 0, 1.0).otherwise(
        (F.col("between") / F.nullif(F.col("k") - 1, F.lit(0))) / (F.col("within") / (F.col("rows") - F.col("k"))))
    return sums.select(*by, value.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., davies_bouldin): mean over clusters of the worst (s_i + s_j) / d_ij."""
    by = list(by)
    centres = broadcast_if_small(cluster_centres(df, vec, label, by).select(*by, "label", "centre"), MAX_CLUSTERS)
    rows = df.select(*[col(b) for b in by], col(label).alias("label"), doubles(col(vec)).alias("__v"))
    spread = (rows.join(centres, [*by, "label"])
              .select(*by, "label", "centre", F.sqrt(squared_distance(F.col("__v"), F.col("centre"))).alias("d"))
              .groupBy(*by, "label").agg(F.avg("d").alias("s"), F.first("centre").alias("c")))
    # one row per labeling: the k clusters as one array, compared among themselves
    packed = spread.groupBy(*by).agg(F.collect_list(F.struct("label", "s", "c")).alias("g"))
    worst = F.transform("g", lambda p: F.array_max(F.transform(
        F.filter("g", lambda q: q["label"] != p["label"]),
        lambda q: F.when(squared_distance(p["c"], q["c"]) > 0,
                         (p["s"] + q["s"]) / F.sqrt(squared_distance(p["c"], q["c"]))).otherwise(0.0))))
    return packed.select(*by, (F.aggregate(worst, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
                               / F.size("g")).alias("davies_bouldin"))


# --- agreement of labelings ---------------------------------------------------------

def _pairs(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1.0) / 2.0


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(col(a).isNotNull() & col(b).isNotNull()) \
        .groupBy(*[col(x) for x in by], col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ari) from the contingency table; two trivial labelings agree with 1."""
    by = list(by)
    cells = contingency(df, a, b, by)
    # the contingency table has one row per pair of labels; sum of n (na - 1) / 2 over the cells
    # of a row is the number of pairs inside that row
    full = cells.select(*by, "n", F.sum("n").over(W.partitionBy(*by, "a")).alias("na"),
                        F.sum("n").over(W.partitionBy(*by, "b")).alias("nb"))
    inside = lambda m: F.sum(F.col("n") * (F.col(m) - 1).cast("double") / 2.0)
    sums = full.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("both"), inside("na").alias("pa"),
                                 inside("nb").alias("pb"), F.sum("n").alias("n"))
    chance = F.col("pa") * F.col("pb") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2.0
    agree = (F.col("both") - chance) / F.nullif(top - chance, F.lit(0.0))
    return sums.select(*by, F.coalesce(agree, F.lit(1.0)).alias("ari"))


def normalized_mutual_info(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., nmi), mutual information over the arithmetic mean of the entropies."""
    by = list(by)
    cells = contingency(df, a, b, by)
    w = lambda *k: W.partitionBy(*by, *k) if (by or k) else W.partitionBy(F.lit(0))
    # the contingency table has one row per pair of labels
    full = cells.select(*by, "n", F.sum("n").over(w("a")).alias("na"), F.sum("n").over(w("b")).alias("nb"),
                        F.sum("n").over(w()).alias("t"))
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "t"))
    out = full.groupBy(*by).agg(
        F.sum(n / t * F.log(n * t / (na * nb))).alias("mi"),
        F.sum(-n / t * F.log(na / t)).alias("ha"), F.sum(-n / t * F.log(nb / t)).alias("hb"))
    both = (F.col("ha") + F.col("hb")) / 2.0
    return out.select(*by, F.when(both <= 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / both).alias("nmi"))


def mean_agreement(df: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """(stability_ari): mean ARI of one labeling with several others, all in one pass over the rows."""
    long = df.select(col(base).alias("a"), F.inline(F.array(*[F.struct(
        F.lit(o).alias("run"), col(o).cast("int").alias("b")) for o in others])))
    return adjusted_rand(long, "a", "b", ["run"]).agg(F.avg("ari").alias("stability_ari"))


def seed_stability(df: DataFrame, base: str, k: int, fit: Callable[[DataFrame, int, int, str], DataFrame],
                   seeds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Mean ARI of the base labels with refits under other seeds. ``fit(df, k, seed, out)`` adds labels; a fit that has
    ``many(df, [(k, seed, out, bit)], mask)`` adds all of them in common passes."""
    runs = [f"__run{s}" for s in seeds]
    many = getattr(fit, "many", None)
    labelled = many(df, [(k, s, r, 0) for s, r in zip(seeds, runs)]) if many else reduce(lambda d, s: fit(d, k, s, f"__run{s}"), seeds, df)
    return mean_agreement(labelled, base, runs)


def subsample(df: DataFrame, id_col: str, share: float, rep: int, seed: int = 2026) -> DataFrame:
    """Exactly ``floor(share * n)`` rows without replacement, the same on any partitioning."""
    take = int(df.count() * share)
    return df.filter(lowest_k(df, stable_key(col(id_col), seed, rep), col(id_col), {None: take}))


def subsamples(df: DataFrame, id_col: str, reps: int = 8, share: float = 0.8, seed: int = 2026) -> list[DataFrame]:
    """The subsamples of a bootstrap; several candidates can be compared on the same ones."""
    return [subsample(df, id_col, share, rep, seed) for rep in range(reps)]


def bootstrap_stability(parts: Sequence[DataFrame], base: str, k: int,
                        fit: Callable[[DataFrame, int, int, str], DataFrame], seed: int = 2026) -> DataFrame:
    """Mean ARI between base labels and labels refitted on each subsample, compared on the subsample.

    The index does not change when clusters are renumbered, so the refits keep their numbers.
    """
    runs = [fit(part, k, seed + 1 + rep, "__refit").select(
        F.lit(rep).alias("rep"), col(base).alias("a"), F.col("__refit").alias("b")) for rep, part in enumerate(parts)]
    return adjusted_rand(reduce(DataFrame.unionByName, runs), "a", "b", ["rep"]).agg(F.avg("ari").alias("stability_ari"))


def subsample_mask(df: DataFrame, id_col: str, reps: int = 8, share: float = 0.8, seed: int = 2026) -> Column:
    """A bit per subsample of :func:`subsamples`, set where the row is in it."""
    if reps > 63:
        raise ValueError("a mask has 63 bits; ask for more subsamples in several calls")
    take = {None: int(df.count() * share)}
    bits = [lowest_k(df, stable_key(col(id_col), seed, rep), col(id_col), take).cast("long") * (1 << rep) for rep in range(reps)]
    return reduce(lambda a, b: a + b, bits)


def masked_stability(df: DataFrame, labelings: Mapping[str, int], fit, mask: Column, reps: int = 8, seed: int = 2026) -> DataFrame:
    """(labeling, stability_ari): mean ARI between base labels and labels refitted on each subsample of ``mask``, compared on the
    subsample. ``labelings`` maps columns of base labels to their numbers of clusters; all refits are made by one ``fit.many``."""
    runs = [(k, seed + 1 + rep, f"__refit{i}_{rep}", rep) for i, k in enumerate(labelings.values()) for rep in range(reps)]
    labelled = fit.many(df.withColumn("__mask", mask), runs, "__mask")
    cells = [F.struct(F.lit(name).alias("labeling"), F.lit(rep).alias("rep"), col(name).cast("int").alias("a"), F.col(f"__refit{i}_{rep}").alias("b"))
             for i, name in enumerate(labelings) for rep in range(reps)]
    long = labelled.select("__mask", F.inline(F.array(*cells))).filter(F.expr("shiftright(__mask, rep) & 1 = 1"))
    return adjusted_rand(long, "a", "b", ["labeling", "rep"]).groupBy("labeling").agg(F.avg("ari").alias("stability_ari"))


# --- separation of values -----------------------------------------------------------

def _cells(values: Mapping[str, Column]) -> list[Column]:
    """Count, mean and sum of squared deviations per feature, as one wide aggregate."""
    return [x for i, v in enumerate(values.values()) for x in (
        F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), (F.var_pop(v) * F.count(v)).alias(f"w{i}"))]


def group_moments(df: DataFrame, label: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, label, n, mean, within) per cluster. Rows are aggregated wide and only the
    result, one row per cluster, is turned into long form."""
    values = {c: safe_numeric(col(c)) for c in columns}
    wide = df.groupBy(*[col(b) for b in by], col(label).alias("label")).agg(*_cells(values))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                               F.col(f"w{i}").alias("within")) for i, c in enumerate(columns)])
    return wide.select(*by, "label", F.inline(cells)).filter(F.col("n") > 0)


def effect_sizes(moments: DataFrame, by: Sequence[str] = (), min_values: int = 0,
                 extra: Sequence[Column] = ()) -> DataFrame:
    """(by..., feature, n, eta_squared, max_mean_diff, varies, extra...) from :func:`group_moments`.

    ``extra`` are further aggregates over the cluster rows of a feature.
    """
    keys = [*by, "feature"]
    centred = moments.withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(W.partitionBy(*keys)) / F.sum("n").over(W.partitionBy(*keys)))
    out = centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("within").alias("__within"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("__between"),
        (F.max("mean") - F.min("mean")).alias("max_mean_diff"), *extra)
    total = F.col("__between") + F.col("__within")
    return out.filter(F.col("n") >= min_values).withColumns({
        "eta_squared": F.when(total > 0, F.col("__between") / total).otherwise(0.0),
        "varies": total > 0}).drop("__between", "__within")


def anova_eta2(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(feature, eta_squared): between over total sum of squares; a constant column gives 0."""
    return effect_sizes(group_moments(df, label, columns)).select("feature", "eta_squared")


def external_separation(df: DataFrame, label: str, columns: Sequence[str], min_values: int = 30) -> DataFrame:
    """One row: mean eta squared over the held-out columns with enough values and any variance."""
    sizes = effect_sizes(group_moments(df, label, columns), min_values=min_values)
    return sizes.filter("varies").agg(F.coalesce(F.avg("eta_squared"), F.lit(0.0)).alias("external_separation"),
                                      F.count(F.lit(1)).alias("n_features"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), **rank_options) -> DataFrame:
    """(by..., n, spearman): average ranks, pairs with a missing side left out.

    Ranks are taken over the distinct values and joined to tallies of equal pairs, never to the rows.
    """
    by = list(by)
    pairs = df.select(*[col(b) for b in by], safe_numeric(col(x)).alias("__x"), safe_numeric(col(y)).alias("__y"))
    pairs = pairs.filter("__x IS NOT NULL AND __y IS NOT NULL")
    counted = tally(pairs, *by, "__x", "__y")
    ranked = counted
    for value, rank in (("__x", "__rx"), ("__y", "__ry")):
        ranked = ranked.join(value_ranks(counted, value, by, rank=rank, rows=pairs, **rank_options), [*by, value])
    w = F.col("n").cast("double")
    rx, ry = F.col("__rx"), F.col("__ry")
    sums = ranked.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
                                   F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"),
                                   F.sum(w * rx * ry).alias("sxy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(*by, F.col("n").cast("long").alias("n"),
                       (cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("spearman"))


def cluster_size_balance(df: DataFrame, label: str, small: int = 50) -> DataFrame:
    """(cluster, n, share, min_share, max_share, is_small) per cluster."""
    sizes = df.groupBy(col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))  # over the few cluster rows
    share = F.col("n") / F.sum("n").over(every)
    return (sizes.withColumn("share", share)
            .select("cluster", "n", "share", F.min("share").over(every).alias("min_share"),
                    F.max("share").over(every).alias("max_share"), (F.col("n") < small).alias("is_small")))


def retrieval_top1(left: DataFrame, right: DataFrame, id_col: str, left_vec: str, right_vec: str,
                   block_rows: int = 2048) -> DataFrame:
    """(n, hits, top1): share of rows whose most similar other-view vector (cosine) is their own.

    Ties go to the smaller id. The pairs of a block keep one best match per row.
    """
    a = left.select(col(id_col).alias("id"), as_stored(left, left_vec).alias("v"))
    b = right.select(col(id_col).alias("id"), as_stored(right, right_vec).alias("v"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("id", kind="stable")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        # rounded so that equal vectors tie whatever the block they are multiplied in
        sim = np.round(unit(stack(x["v"])) @ unit(stack(y["v"])).T, 12)
        at = sim.argmax(axis=1)
        return pd.DataFrame({"id": x["id"].to_numpy(), "sim": sim[np.arange(len(x)), at],
                             "found": y["id"].to_numpy()[at]})

    def best_of(parts: pd.DataFrame) -> pd.DataFrame:
        # of equal similarities the smaller id; a similarity that is no number counts as the greatest, as in the aggregate below
        return parts.sort_values("found", kind="stable").sort_values("sim", ascending=False, kind="stable", na_position="first").drop_duplicates("id")

    id_type = a.schema["id"].dataType.simpleString()
    partial = block_pairs(a, b, "id", "id", best, f"id {id_type}, sim double, found {id_type}", block_rows, best_of)
    match = partial.groupBy("id").agg(F.max(F.struct("sim", (-F.col("found")).alias("neg"))).alias("m"))
    return match.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == -F.col("m.neg")).alias("hits")) \
        .select("n", "hits", (F.col("hits") / F.col("n")).alias("top1"))


# --- choosing among candidates: metric tables have one row per candidate ---------------

def select_best_k(grid: DataFrame, by: Sequence[str] = (), k: str = "k", low: int = 3, high: int = 6) -> DataFrame:
    """The row with the best silhouette, then stability, among k in [low, high]; else among all k."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = w.orderBy(F.desc("in_range"), F.desc("silhouette"), F.desc("stability_ari"), k)
    return (grid.withColumn("in_range", F.col(k).between(low, high))
            .withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r"))


def minmax_scores(grid: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("method",),
                  davies_bouldin: str | None = "davies_bouldin") -> DataFrame:
    """Add ``combined_score``: mean of the metrics scaled to 0-1 among the candidates of ``by``.

    A constant metric counts 0; the Davies-Bouldin index enters as 1 / (1 + index).
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    parts = {m: col(m) for m in metrics}
    if davies_bouldin:
        parts["__db"] = 1.0 / (1.0 + col(davies_bouldin))
    src = grid.withColumns({f"__v{i}": v for i, v in enumerate(parts.values())})
    scaled = []
    for i in range(len(parts)):
        v, lo, hi = F.col(f"__v{i}"), F.min(f"__v{i}").over(w), F.max(f"__v{i}").over(w)
        scaled.append(F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))
    combined = reduce(lambda a, b: a + b, scaled) / float(len(scaled))
    return src.withColumn("combined_score", combined).drop(*[f"__v{i}" for i in range(len(parts))])


def select_minmax_score(grid: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("method",),
                        ties: Sequence[str] = ("k",), **options) -> DataFrame:
    """The candidate with the highest combined score per ``by``."""
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(F.desc("combined_score"), *ties)
    return minmax_scores(grid, metrics, by, **options).withColumn("__r", F.row_number().over(w)) \
        .filter("__r = 1").drop("__r")


#: fixed values: weights of the selection score
SELECTION_WEIGHTS = {
    "silhouette": 0.25, "davies_bouldin": 0.20, "external_separation": 0.25, "stability_ari": 0.20,
    "min_cluster_ratio": 0.10,
}


def weighted_scores(grid: DataFrame, weights: Mapping[str, float] = SELECTION_WEIGHTS) -> DataFrame:
    value = lambda m: 1.0 / (1.0 + col(m)) if m == "davies_bouldin" else col(m)
    return grid.withColumn("selection_score", reduce(lambda a, b: a + b, [F.lit(w) * value(m) for m, w in weights.items()]))


def select_weighted_score(grid: DataFrame, by: Sequence[str] = ("method",), ties: Sequence[str] = ("clusterer", "k"),
                          weights: Mapping[str, float] = SELECTION_WEIGHTS) -> DataFrame:
    """The candidate with the highest weighted score per method."""
    w = W.partitionBy(*by).orderBy(F.desc("selection_score"), *ties)
    return weighted_scores(grid, weights).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def method_ranking(grid: DataFrame, best: DataFrame, keys: Sequence[str] = ("method", "clusterer", "k"),
                   order: Sequence[str] = ("external_separation", "silhouette")) -> DataFrame:
    """The grid rows of each method's best candidate, ranked by several metrics."""
    rows = grid.join(best.select(*keys), list(keys))
    w = W.partitionBy(F.lit(0)).orderBy(*[F.desc(c) for c in order], *keys)
    return rows.withColumn("rank", F.row_number().over(w))


def pick_finalists(grid: DataFrame, finalists: Sequence[Mapping[str, object]]) -> DataFrame:
    """The rows of a fixed set of candidates, in the given order."""
    picks = [grid.filter(reduce(lambda a, b: a & b, [col(c) == F.lit(v) for c, v in f.items()]))
             .withColumn("finalist", F.lit(i)) for i, f in enumerate(finalists)]
    return reduce(DataFrame.unionByName, picks)


def metrics_long(grid: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys..., metric, value)"""
    return melt(grid, keys, metrics, "metric", "value")
