"""Profiles, rank tests, names and counterfactuals of clusters (H1-H12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chi2 import tail_column
from ..functions.columns import col, fixed, melt, safe_numeric
from ..functions.ranks import exact_quantiles, with_ranks
from ..functions.sizes import broadcast_if_small, few_rows, one_row
from ..functions.vectors import dot, doubles, literal, squared_distance, subtract
from .clean import readable_value
from .evaluate import cluster_centres, effect_sizes, group_moments, spearman


def cluster_profile_means(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, n_rows, mean per column)"""
    return df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("n_rows"),
                                      *[F.avg(safe_numeric(col(c))).alias(c) for c in columns])


def kruskal_wallis(df: DataFrame, label: str, columns: Sequence[str], **rank_options) -> DataFrame:
    """(feature, n, n_groups, h, p_value, max_mean_diff) per feature.

    Rank sums come from tallies of (feature, value, cluster), so equal values cost one
    row each. Features with fewer than two clusters are left out; if all values are
    equal, h is unknown and p is 1.
    """
    long = melt(df, [label], columns).withColumnRenamed(label, "label")
    cells = long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_ranks(cells, "value", ["feature"], rank="rank", peers="ties", rows=long, **rank_options)
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    # sum over the cells of one value of n (t^2 - 1) is t^3 - t
    groups = ranked.groupBy("feature", "label").agg(
        F.sum(n).alias("n"), F.sum(n * F.col("rank")).alias("r"), F.sum(n * F.col("value")).alias("s"),
        F.sum(n * (ties * ties - 1.0)).alias("t"))
    whole = groups.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"),
        F.sum("t").alias("t"), (F.max(F.col("s") / F.col("n")) - F.min(F.col("s") / F.col("n"))).alias("max_mean_diff"))
    size = F.col("n")
    raw = 12.0 / (size * (size + 1.0)) * F.col("q") - 3.0 * (size + 1.0)
    correction = 1.0 - F.col("t") / F.nullif(size * size * size - size, F.lit(0.0))
    tested = whole.filter(F.col("n_groups") >= 2).withColumn("h", raw / F.nullif(correction, F.lit(0.0)))
    return tested.select("feature", size.cast("long").alias("n"), "n_groups", "h",
                         F.coalesce(tail_column(F.col("h"), F.col("n_groups") - 1), F.lit(1.0)).alias("p_value"),
                         "max_mean_diff")


def bh_fdr(tests: DataFrame, p: str = "p_value", out: str = "q_value_fdr", ties: Sequence[str] = ("feature",),
           by: Sequence[str] = ()) -> DataFrame:
    """Add the Benjamini-Hochberg q value: running minimum of p n / rank from the largest p down.

    There is one row per tested feature, so one window over them is small.
    """
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = part.orderBy(col(p), *[col(t) for t in ties])
    step = tests.withColumn("__s", col(p) * F.count(F.lit(1)).over(part) / F.row_number().over(order))
    least = F.min("__s").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    return step.withColumn(out, F.greatest(F.least(least, F.lit(1.0)), F.lit(0.0))).drop("__s")


def external_stats_table(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Rank test, effect size and q value per held-out feature, strongest first."""
    tests = kruskal_wallis(df, label, columns).drop("max_mean_diff", "n")
    sizes = effect_sizes(group_moments(df, label, columns)).drop("varies")
    joined = bh_fdr(tests.join(sizes, "feature"))
    return joined.orderBy("q_value_fdr", F.desc("eta_squared"), F.desc("max_mean_diff"), "feature")


def top_markers(df: DataFrame, label: str, columns: Sequence[str], clusters: Sequence | None = None,
                min_values: int = 50) -> DataFrame:
    """(feature, eta_squared, cluster_<c>_mean...) ranked by effect size."""
    moments = group_moments(df, label, columns)
    if clusters is None:
        clusters = sorted(r[0] for r in few_rows(df.select(col(label)).distinct(), 1_000, "clusters"))
    names = {f"cluster_{c}_mean": c for c in clusters}
    means = [F.max(F.when(F.col("label") == F.lit(c), F.col("mean"))).alias(name) for name, c in names.items()]
    sizes = effect_sizes(moments, min_values=min_values, extra=means)
    return sizes.select("feature", "eta_squared", *[col(c) for c in names]).orderBy(F.desc("eta_squared"), "feature")


def markers_long(df: DataFrame, label: str, columns: Sequence[str], min_values: int = 50) -> DataFrame:
    """(feature, eta_squared, label, mean): ``top_markers`` with a row instead of a column per cluster, for any number of them."""
    moments = group_moments(df, label, columns)
    sizes = effect_sizes(moments, min_values=min_values).select("feature", "eta_squared")
    return moments.select("feature", "label", "mean").join(sizes, "feature").select("feature", "eta_squared", "label", "mean")


def name_clusters(df: DataFrame, label: str, domains: Mapping[str, str], floor: float = 0.2) -> DataFrame:
    """(label, cluster_name, top_domains): named after the two domains most often impaired.

    ``domains`` maps a flag column to its display name; ties go by name.
    """
    means = df.groupBy(col(label).alias("label")).agg(*[F.avg(safe_numeric(col(c))).alias(c) for c in domains])
    best = F.slice(F.array_sort(F.array(*[F.struct((-col(c)).alias("neg"), F.lit(n).alias("name"))
                                          for c, n in domains.items()])), 1, 2)
    names = F.transform(best, lambda p: p["name"])
    both = F.aggregate(best, F.lit(0.0), lambda s, p: s - p["neg"]) / F.size(best)
    return means.select(
        "label", F.when(both < floor, F.lit("Low-impairment"))
        .otherwise(F.concat(F.array_join(names, " + "), F.lit("-impaired"))).alias("cluster_name"),
        F.array_join(names, ", ").alias("top_domains"))


def phrase(value: Column, low: float | None = None, low_text: str | None = None, high: float | None = None,
           high_text: str | None = None) -> Column:
    """A phrase when the value lies under ``low`` or over ``high``, else NULL."""
    out = F.lit(None).cast("string")
    if high is not None:
        out = F.when(value > high, F.lit(high_text)).otherwise(out)
    if low is not None:
        out = F.when(value < low, F.lit(low_text)).otherwise(out)
    return out


def cluster_interpretation(profile: DataFrame, label: str, overall: str, bands: tuple[float, str, str, float, str],
                           domains: Sequence[tuple], outcomes: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(label, interpretation) from a profile of cluster means.

    ``bands`` is (low, low text, middle text, high, high text) for the overall score;
    ``domains`` holds (column, low, low text, high, high text), the limits may be None;
    ``outcomes`` holds (column, name, decimals) and are quoted when present.
    """
    low, low_text, mid_text, high, high_text = bands
    whole = F.when(col(overall) < low, F.lit(low_text)).when(col(overall) > high, F.lit(high_text)).otherwise(F.lit(mid_text))
    traits = F.array_compact(F.array(*[phrase(col(c), *limits) for c, *limits in domains]))
    quoted = F.array_compact(F.array(*[
        F.concat(F.lit(f"{name}="), fixed(col(c), digits)) for c, name, digits in outcomes
        if c in profile.columns]))
    text = F.concat_ws(
        " ", F.concat(F.lit("Cluster "), col(label).cast("string"), F.lit(f": {overall}="), fixed(col(overall), 1), F.lit(".")), whole,
        F.when(F.size(traits) > 0, F.concat(F.lit("Traits: "), F.array_join(traits, ", "), F.lit("."))),
        F.when(F.size(quoted) > 0, F.concat(F.lit("Outcomes: "), F.array_join(quoted, ", "), F.lit("."))))
    return profile.select(col(label), text.alias("interpretation"))


def gradient_summary(df: DataFrame, label: str, overall: str, domains: Sequence[str],
                     outcomes: Sequence[str]) -> DataFrame:
    """(outcome, worst_value, best_value, order_spearman, top_domain, top_range).

    Worst and best are the clusters with the lowest and highest mean ``overall``; the
    correlation is between cluster order and outcome mean.
    """
    names = list(dict.fromkeys([overall, *domains, *outcomes]))
    means = df.groupBy(col(label).alias("label")).agg(*[F.avg(safe_numeric(col(c))).alias(c) for c in names])
    span = means.agg(*[(F.max(c) - F.min(c)).alias(f"d{i}") for i, c in enumerate(domains)]) if domains else None
    spans = {} if span is None else {d: v for d, v in zip(domains, one_row(span)) if v is not None}
    widest = max(spans, key=spans.get) if spans else None
    # clusters are ordered by mean and label together; their places are distributed ranks, not one window over all of them
    placed = means.withColumns({"__key": F.struct(col(overall).alias("m"), F.col("label")), "__n": F.lit(1).cast("long")})
    order = with_ranks(placed, "__key", n="__n", rank="__avg", before="__order")
    long = order.select("__order", F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), col(o).alias("value")) for o in outcomes])))
    ends = long.groupBy("outcome").agg(F.min_by("value", "__order").alias("worst_value"),
                                       F.max_by("value", "__order").alias("best_value"))
    rho = spearman(long, "__order", "value", ["outcome"]).select("outcome", F.col("spearman").alias("order_spearman"))
    return ends.join(rho, "outcome").select(
        "outcome", "worst_value", "best_value", "order_spearman", F.lit(widest).cast("string").alias("top_domain"),
        F.lit(spans.get(widest)).cast("double").alias("top_range"))


def pseudotime(df: DataFrame, id_col: str, vec: str, outcome: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(id, outcome, pseudotime): position between the mean vector of the rows with a low outcome (0)
    and that of the rows with a high one, scaled to 0-1 over all rows."""
    y = safe_numeric(col(outcome))
    cut_low, cut_high = exact_quantiles(df, {"y": (y, [low, high])})["y"]
    ready = df.select(col(id_col).alias("id"), y.alias("outcome"), doubles(col(vec)).alias("v"))
    vector = array_to_vector("v")
    ends = one_row(ready.agg(
        Summarizer.mean(vector, F.coalesce((F.col("outcome") <= cut_low).cast("double"), F.lit(0.0))).alias("a"),
        Summarizer.mean(vector, F.coalesce((F.col("outcome") >= cut_high).cast("double"), F.lit(0.0))).alias("b")))
    start, axis = ends["a"].toArray(), ends["b"].toArray() - ends["a"].toArray()
    length = float(axis @ axis) + 1e-8
    placed = ready.select("id", "outcome", (dot(subtract(F.col("v"), literal(start)), literal(axis)) / length).alias("t"))
    ends = one_row(placed.agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    return placed.select("id", "outcome", ((F.col("t") - ends["lo"]) / (ends["hi"] - ends["lo"] + 1e-8)).alias("pseudotime"))


def cluster_medoids(df: DataFrame, id_col: str, vec: str, label: str, n: int = 3,
                    clusters: Sequence | None = None) -> DataFrame:
    """(label, id, distance2, place): the ``n`` rows nearest to each cluster's centre.

    Filtering on the row number lets Spark cut every cluster to ``n`` rows before the shuffle.
    """
    src = df.select(col(id_col).alias("id"), col(label).alias("label"), doubles(col(vec)).alias("v"))
    if clusters is not None:
        src = src.filter(F.col("label").isin(*clusters))
    centres = broadcast_if_small(cluster_centres(src, "v", "label").select("label", "centre"))
    near = src.join(centres, "label").select("label", "id", squared_distance(F.col("v"), F.col("centre")).alias("distance2"))
    order = W.partitionBy("label").orderBy("distance2", "id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def worst_and_best(df: DataFrame, label: str, outcome: str):
    """Cluster numbers with the highest and the lowest mean outcome; ties in the mean are settled by the label."""
    means = df.groupBy(col(label).alias("label")).agg(F.avg(safe_numeric(col(outcome))).alias("m")).filter("m IS NOT NULL")
    place = F.struct("m", "label")
    row = one_row(means.agg(F.max_by("label", place).alias("worst"), F.min_by("label", place).alias("best")))
    return row["worst"], row["best"]


def prototype_counterfactual(df: DataFrame, id_col: str, vec: str, label: str, outcome: str,
                             fields: Sequence[str], n: int = 3, top: int = 6) -> DataFrame:
    """The worst cluster's medoids, each with its nearest row of the best cluster and their
    ``top`` largest differences as text. A row whose vector lacks a number has no place and is no prototype
    and no counterfactual; it still counts for the outcomes and deviations.

    The ends are two clusters out of any number; then the worst one's centre and the deviations come in one aggregate, the
    medoids as a top-n, and one scan of the best cluster keeps the nearest row per medoid without a shuffle of rows.
    """
    number = {c: safe_numeric(col(c).cast("string")) for c in fields}
    placed = F.coalesce(F.forall(doubles(col(vec)), lambda x: x.isNotNull()), F.lit(False))
    worst, best = worst_and_best(df, label, outcome)
    # a row without a place is no part of the centre: it stands in with another cluster's weight, 0
    inside = placed if worst is None else placed & F.coalesce(col(label) == F.lit(worst), F.lit(False))
    blank = F.array_repeat(F.lit(0.0), one_row(df.agg(F.max(F.size(doubles(col(vec)))).alias("d")))["d"] or 0)
    facts = one_row(df.agg(
        Summarizer.mean(array_to_vector(F.coalesce(F.when(placed, doubles(col(vec))), blank)), inside.cast("double")).alias("centre"),
        *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(number.values())]))
    centre, spread = facts["centre"].toArray(), [facts[f"s{i}"] for i in range(len(fields))]
    facts = F.struct(col(id_col).alias("id"), col(outcome).alias("outcome"),
                     *[x for i, c in enumerate(fields) for x in (
                         number[c].alias(f"x{i}"), col(c).cast("string").alias(f"r{i}"),
                         readable_value(col(c)).alias(f"s{i}"))])
    rows = df.filter(placed).select(col(label).alias("label"), doubles(col(vec)).alias("v"), facts.alias("facts"))
    medoids = (rows.filter(F.col("label") == worst)
               .withColumn("d", squared_distance(F.col("v"), literal(centre)))
               .orderBy("d", "facts.id").limit(n)
               .select(F.lit(best).alias("label"), F.col("v").alias("qv"), F.col("facts").alias("q")))
    near = (rows.filter(F.col("label") == best).join(broadcast_if_small(medoids, n), "label")
            .select("q", "facts", squared_distance(F.col("v"), F.col("qv")).alias("d"))
            .groupBy(F.col("q.id").alias("qid")).agg(
                F.first("q").alias("q"), F.min_by("facts", F.struct("d", "facts.id")).alias("c")))
    diffs = []
    for i, c in enumerate(fields):
        a, b = F.col(f"q.x{i}"), F.col(f"c.x{i}")
        numeric = F.abs(a - b) / ((spread[i] or 1.0) + 1e-6)
        differs = ~F.col(f"q.r{i}").eqNullSafe(F.col(f"c.r{i}"))
        size = F.when(a.isNotNull() & b.isNotNull(), numeric).when(differs, 1.0)
        text = F.concat(F.lit(f"{c}: "), F.col(f"q.s{i}"), F.lit(" -> "), F.col(f"c.s{i}"))
        diffs.append(F.struct((-size).alias("neg"), F.lit(i).alias("i"), text.alias("text")))
    largest = F.slice(F.array_sort(F.filter(F.array(*diffs), lambda d: d["neg"].isNotNull())), 1, top)
    return near.select(
        F.col("q.id").alias("query_id"), F.lit(worst).alias("query_cluster"), F.col("q.outcome").alias("query_outcome"),
        F.col("c.id").alias("counterfactual_id"), F.lit(best).alias("counterfactual_cluster"),
        F.col("c.outcome").alias("counterfactual_outcome"),
        F.array_join(F.transform(largest, lambda d: d["text"]), " | ").alias("top_feature_changes"))


def direction_table(df: DataFrame, label: str, outcome: str, columns: Sequence[str],
                    min_present: float = 0.7) -> DataFrame:
    """(feature, best_mean, worst_mean, delta, standardized_delta), largest absolute shift first.

    Two aggregates, however many clusters there are: the ends, then the columns at the ends and over all rows.
    """
    worst, best = worst_and_best(df, label, outcome)
    at = lambda c, v: F.avg(F.when(col(label) == F.lit(c), v))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(columns) for v in [safe_numeric(col(c))] for x in (
        F.count(v).alias(f"n{i}"), F.stddev_samp(v).alias(f"s{i}"), at(best, v).alias(f"b{i}"), at(worst, v).alias(f"w{i}"))])
    long = facts.select("rows", F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"b{i}").alias("best_mean"),
        F.col(f"w{i}").alias("worst_mean")) for i, c in enumerate(columns)])))
    kept = long.filter((F.col("n") >= min_present * F.col("rows")) & (F.col("s") > 0)).withColumn("delta", F.col("best_mean") - F.col("worst_mean"))
    return kept.select("feature", "best_mean", "worst_mean", "delta", (F.col("delta") / (F.col("s") + 1e-8)).alias("standardized_delta")).orderBy(
        F.desc(F.abs("standardized_delta")), "feature")
