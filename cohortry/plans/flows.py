"""Analyses composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.blocks import few_parts
from ..functions.columns import col
from ..functions.sizes import broadcast_if_small
from ..operators import clean, embed, evaluate, features, many_starts, predict, profile, score


def impairment_profile(df: DataFrame, numeric: Sequence[str], rules: Sequence[score.Rule], label: str,
                       strata: Sequence[score.StratumRule] = ()) -> DataFrame:
    """Missing tokens out, numbers read, domain flags, total, level; then the mean of each per ``label``."""
    tidy = clean.to_numeric(clean.normalize_missing(df), numeric)
    domains = list(dict.fromkeys([r.domain for r in rules] + [s.domain for s in strata]))
    flagged = score.impairment_total_level(score.domain_flags(tidy, rules, strata), domains)
    high = flagged.withColumn("high", (F.col("level") == "High").cast("int"))
    return profile.cluster_profile_means(high, label, [*domains, "total", "high"])


# --- candidate clusterings ----------------------------------------------------------

@dataclass(frozen=True)
class Fitter:
    """``fit(df, k, seed, out)`` adds labels; ``many`` adds those of several runs, each on the rows with its bit of ``mask``."""

    clusterer: str
    vec: str
    n_init: int

    def __call__(self, df: DataFrame, k: int, seed: int, out: str) -> DataFrame:
        if self.clusterer == "kmeans":
            return embed.kmeans_labels(df, k, seed, self.n_init, self.vec, out)
        return embed.gmm_labels(df, k, seed, self.n_init, self.vec, out)

    def many(self, df: DataFrame, runs: Sequence[tuple[int, int, str, int]], mask: str | None = None) -> DataFrame:
        asked = [many_starts.Run(k, seed, self.n_init, bit) for k, seed, _, bit in runs]
        fits = many_starts.fitted(df, asked, self.vec, self.clusterer != "kmeans", None if mask is None else col(mask))
        return many_starts.with_labels(df, self.vec, fits, [out for _, _, out, _ in runs])


def fitter(clusterer: str, vec: str, n_init: int | None = None) -> Fitter:
    """The fit of a clusterer for the stability operators: 20 starts of k-means, 5 of a mixture, unless given."""
    return Fitter(clusterer, vec, n_init or (20 if clusterer == "kmeans" else 5))


def evaluation_grid(df: DataFrame, id_col: str, methods: Sequence[str], outcome: str, external: Sequence[str],
                    clusterers: Sequence[str] = ("kmeans", "gmm"), ks: Sequence[int] = (3, 4, 5, 6), seed: int = 2026,
                    n_init: int | None = None, stability: str = "bootstrap", reps: int = 8,
                    silhouette_mode: str = "exact", level: str | None = None) -> DataFrame:
    """One row of metrics per (method, clusterer, k). ``methods`` names vector columns of ``df``.

    Besides the inner metrics: how far the clusters explain the outcome (eta squared), the rank correlation of the outcome
    with the clusters in the order of their mean outcome, and the mutual information with the column ``level``, if given.

    All candidates of a clusterer are fitted in common passes, and so are their refits on the subsamples; each metric is
    computed for all candidates of a method at once, and only the metric rows reach the driver.
    """
    base = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows: list[tuple] = []
    for method in methods:
        candidates = [(c, k) for c in clusterers for k in ks]
        names = [f"{c}:{k}" for c, k in candidates]
        labelled = base
        for c in clusterers:
            labelled = fitter(c, method, n_init).many(labelled, [(k, seed, f"{c}:{k}", 0) for k in ks])
        labelled = labelled.withColumn("__v", vector_to_array(col(method))).persist(StorageLevel.MEMORY_AND_DISK)
        carried = dict.fromkeys([*external, outcome, *([level] if level else [])])
        long = labelled.select(col(id_col), "__v", *[col(c) for c in carried], F.inline(F.array(*[
            F.struct(F.lit(n).alias("labeling"), col(n).alias("cluster")) for n in names])))
        by = ["labeling"]
        sizes = evaluate.effect_sizes(evaluate.group_moments(long, "cluster", list(dict.fromkeys([*external, outcome])), by), by)
        mean = long.groupBy("labeling", "cluster").agg(F.avg(col(outcome)).alias("__m"))
        place = F.row_number().over(Window.partitionBy("labeling").orderBy("__m", "cluster"))
        ordered = long.select("labeling", "cluster", col(outcome)).join(
            broadcast_if_small(mean.select("labeling", "cluster", place.alias("__place"))), ["labeling", "cluster"])
        tables = [
            evaluate.spearman(ordered, "__place", outcome, by).select("labeling", F.col("spearman").alias("outcome_spearman")),
            *([evaluate.normalized_mutual_info(long, "cluster", level, by).select("labeling", F.col("nmi").alias("level_nmi"))] if level else []),
            evaluate.silhouette(labelled, id_col, "__v", names, silhouette_mode),
            evaluate.calinski_harabasz(long, "__v", "cluster", by), evaluate.davies_bouldin(long, "__v", "cluster", by),
            long.groupBy("labeling", "cluster").count().groupBy("labeling").agg(
                (F.min("count") / F.sum("count")).alias("min_cluster_ratio"), (F.max("count") / F.sum("count")).alias("max_cluster_ratio")),
            sizes.groupBy("labeling").agg(
                F.avg(F.when(F.col("varies") & (F.col("n") >= 30) & F.col("feature").isin(*external), F.col("eta_squared"))).alias("external_separation"),
                F.max(F.when(F.col("feature") == outcome, F.col("eta_squared"))).alias("outcome_eta2")),
        ]
        found: dict[str, dict] = {n: {} for n in names}
        for t in tables:
            for r in t.collect():  # one row per candidate
                found[r["labeling"]].update(r.asDict())
        mask = evaluate.subsample_mask(labelled, id_col, reps, seed=seed) if stability == "bootstrap" else None
        for c in clusterers:
            fit = fitter(c, method, n_init)
            if mask is not None:
                for r in evaluate.masked_stability(labelled, {f"{c}:{k}": k for k in ks}, fit, mask, reps, seed).collect():
                    found[r["labeling"]]["stability_ari"] = r["stability_ari"]
            else:
                for k in ks:
                    found[f"{c}:{k}"]["stability_ari"] = evaluate.seed_stability(labelled, f"{c}:{k}", k, fit, range(reps)).first()["stability_ari"]
        for (c, k), name in zip(candidates, names):
            m = found[name]
            rows.append((method, c, k, m["silhouette"], m["calinski_harabasz"], m["davies_bouldin"],
                         m["stability_ari"], m["min_cluster_ratio"], m["max_cluster_ratio"], m.get("external_separation") or 0.0,
                         m.get("outcome_eta2"), m.get("outcome_spearman"), m.get("level_nmi")))
        labelled.unpersist()
    base.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "method string, clusterer string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, "
              "stability_ari double, min_cluster_ratio double, max_cluster_ratio double, external_separation double, "
              "outcome_eta2 double, outcome_spearman double, level_nmi double")


def subtype(df: DataFrame, id_col: str, outcome: str, external: Sequence[str], pca_dims: int,
            grid_options: Mapping | None = None, **design_options) -> dict[str, DataFrame]:
    """Design matrix, linear embedding, candidate grid, weighted choice, ordered labels and their profile."""
    matrix, _ = features.design_matrix(df, id_col, keep=[outcome, *external], **design_options)
    embedded = embed.pca_embed(matrix, pca_dims, out="PCA").drop("features").persist(StorageLevel.MEMORY_AND_DISK)
    options = dict(grid_options or {})
    grid = evaluation_grid(embedded, id_col, ["PCA"], outcome, external, **options)
    best = evaluate.select_weighted_score(grid).first()
    fit = fitter(best["clusterer"], "PCA", options.get("n_init"))
    labels = embed.reorder_labels(fit(embedded, best["k"], options.get("seed", 2026), "cluster"), "cluster", outcome)
    return {"grid": grid, "assignments": labels.select(col(id_col), "cluster", col(outcome)),
            "profile": profile.cluster_profile_means(labels, "cluster", [outcome, *external]),
            "external_stats": profile.external_stats_table(labels, "cluster", external)}


# --- prediction ---------------------------------------------------------------------

def _scored(model, test: DataFrame) -> DataFrame:
    """(label, prediction, __scores), kept, since the metrics read them several times."""
    out = model.transform(few_parts(test))
    scores = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select("label", "prediction", vector_to_array(col(scores)).alias("__scores")).persist(StorageLevel.MEMORY_AND_DISK)


def _split(df: DataFrame, id_col: str, label: str, exclude: Sequence[str], seed: int, design_options: Mapping):
    matrix, design = features.design_matrix(df, id_col, keep=[label], exclude=exclude, **design_options)
    ready = matrix.withColumn("label", col(label).cast("double"))
    ready = predict.stratified_split(ready, id_col, "label", seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    return ready, design


def predict_clusters(df: DataFrame, id_col: str, cluster: str, leakage: Sequence[str] = (), seed: int = 42,
                     design_options: Mapping | None = None, **model_options) -> DataFrame:
    """Metrics per model of predicting the cluster from features that are no inputs of it."""
    slim = clean.drop_by_pattern(df, leakage, keep=[id_col, cluster])
    ready, _ = _split(slim, id_col, cluster, [], seed, design_options or {})
    classes = sorted(int(r[0]) for r in ready.select("label").distinct().collect())
    models = predict.train_classifiers(ready.filter("is_test = 0"), multiclass=True, seed=seed, **model_options)
    parts = [predict.multiclass_metrics(_scored(m, ready.filter("is_test = 1")), "label", "prediction",
                                        {float(c): F.col("__scores")[c] for c in classes}).withColumn("model", F.lit(n))
             for n, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def predict_low_outcome(df: DataFrame, id_col: str, outcome: str, leakage: Sequence[str] = (), drop: Sequence[str] = (),
                        share: float = 0.25, seed: int = 42, drop_missing: bool = False,
                        design_options: Mapping | None = None, **model_options) -> DataFrame:
    """Metrics per model of predicting a low outcome without the outcome and the leaking columns."""
    labelled = predict.quantile_label(df, outcome, "__low", share, drop_missing)
    slim = clean.drop_by_pattern(labelled.drop(outcome, *drop), leakage, keep=[id_col, "__low"])
    ready, _ = _split(slim, id_col, "__low", [], seed, design_options or {})
    models = predict.train_classifiers(ready.filter("is_test = 0"), seed=seed, **model_options)
    parts = [predict.binary_metrics(_scored(m, ready.filter("is_test = 1")).withColumn("__score", F.col("__scores")[1]),
                                    "label", "prediction", "__score").withColumn("model", F.lit(n))
             for n, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def attribution_with_and_without(df: DataFrame, id_col: str, label: str, leakage: Sequence[str], top: int = 20,
                                 design_options: Mapping | None = None) -> DataFrame:
    """Overlap of the strongest features of a linear model with and without the label's own inputs."""
    rankings = []
    for frame in (df, clean.drop_by_pattern(df, leakage, keep=[id_col, label])):
        matrix, design = features.design_matrix(frame, id_col, keep=[label], **(design_options or {}))
        ready = matrix.withColumn("label", col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
        model = predict.train_classifiers(ready, models=["LR"])["LR"]
        rankings.append(predict.model_attribution(ready, model, design.features))
        ready.unpersist()
    return predict.leakage_sensitivity(*rankings, top=top)
