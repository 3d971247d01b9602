"""Edge cases of the operators and numbers known from literal tables."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.operators import audit, clean, embed, evaluate, features, predict, profile, score
from cohortry.plans import flows, survey
from cohortry.sources import tables
from cohortry.functions.columns import fixed
from cohortry.functions.vectors import as_vector


def rows(df):
    return sorted(tuple(x) for x in df.collect())


# --- sources -----------------------------------------------------------------------

def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿cluster_id,name\n1,甲\n2,乙\n".encode("utf-8"))
    got = tables.scan_artifact(spark, str(tmp_path / "t.csv"), "cluster_id int, name string")
    assert rows(got) == [(1, "甲"), (2, "乙")]


def test_cached_stage_follows_its_inputs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source)
    stage = lambda **p: tables.cached_stage(spark, "s", build, [source], p).count()
    assert stage() == 3 and stage() == 3 and len(calls) == 1
    assert stage(k=2) == 3 and len(calls) == 2
    spark.range(5).write.mode("append").parquet(source)
    assert stage() == 8 and len(calls) == 3


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        tables.scan_cohort(spark, "/nowhere", fmt="csv")


# --- cleaning ----------------------------------------------------------------------

def test_normalize_missing_keeps_blanks_around_values(spark):
    df = spark.createDataFrame([(" nd ",), (" \t\u3000\n",), (" a ",), ("N\\A\t",), ("0",), (None,)], "x string")
    assert [x["x"] for x in clean.normalize_missing(df).collect()] == [None, None, " a ", None, "0", None]


@pytest.mark.parametrize("form, block, want", [
    ("label_code", "女0 男1", {"0": "女", "1": "男"}),
    ("label_code", "无：0，有、1 ,2", {"0": "无", "1": "有"}),
    ("label_code", "a1 b1", {"1": "b"}),
    ("code_label", '01"汉族",02"满族"，3其他', {"01": "汉族", "02": "满族", "3": "其他"}),
    ("range_code", "<1000 1, 1000-2000 2，≥2000 3", {"1": "<1000", "2": "1000-2000", "3": "≥2000"}),
])
def test_codebook_forms(spark, form, block, want):
    df = spark.createDataFrame([("f", block)], "field string, block string")
    assert {x["code"]: x["label"] for x in clean.codebook_extract(df, form).collect()} == want


def test_long_books_are_joined(spark):
    df = spark.createDataFrame([(1, "1.0", "x"), (2, "9", None)], "id int, a string, b string")
    book = spark.createDataFrame([("a", "1", "one"), ("b", "x", "ex")], "field string, code string, label string")
    got = clean.codebook_apply(df, book, ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1, "one", "ex"), (2, "9", None)]


def test_winsorize_and_median_of_an_empty_column(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(101)], "a double, b double")
    out = clean.winsorize(df, ["a", "b"])
    assert out.agg(F.min("a"), F.max("a"), F.count("b")).first() == (1.0, 99.0, 0)
    assert clean.impute_median(df, ["a", "b"]).filter("b IS NOT NULL").count() == 0


def test_rare_levels_and_missing(spark):
    df = spark.createDataFrame([("a",)] * 97 + [("b",)] * 2 + [(None,)], "x string")
    assert rows(clean.collapse_rare(df, ["x"], 0.02).groupBy("x").count()) == [("Other", 1), ("a", 97), ("b", 2)]


def test_sparse_and_named_columns_go(spark):
    df = spark.createDataFrame([(1, None, 2, 3)], "id int, empty double, IC_x int, note int")
    assert clean.drop_sparse_columns(df, 0.95, ["note"], "IC_").columns == ["id"]


def test_readable_value(spark):
    df = spark.createDataFrame([("1.0",), ("2.345",), ("text",), (None,), ("0",)], "x string")
    got = [x["v"] for x in df.select(clean.readable_value(F.col("x"), flag=True).alias("v")).collect()]
    assert got == ["yes", f"{2.345:.2f}", "text", "missing", "no"]


@pytest.mark.parametrize("value", [10.075, 0.125, 0.375, 2.345, 1.005, -0.001, 1234567.895, 22.665])
def test_decimals_are_rounded_like_printf(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(fixed(F.col("x"), 2).alias("v")).first()["v"] == f"{value:.2f}"


# --- audit -------------------------------------------------------------------------

def test_audit_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, x double, s string")
    assert audit.missing_bins(df).agg(F.sum("n_columns")).first()[0] == 3
    assert audit.outlier_scan(df, ["x"]).count() == 0
    assert audit.range_check(df, ["x"]).count() == 0
    assert {x["kind"] for x in audit.classify_columns(df).collect()} == {"categorical"}


def test_column_kinds(spark):
    n = 60
    data = [(f"2020-01-{i % 28 + 1:02d}", str(i), str(i % 3), str(i % 3), f"w{i}", "x" if i % 2 else None) for i in range(n)]
    df = spark.createDataFrame(data, "`检查日期` string, a string, code string, `得分` string, t string, c string")
    got = {x["column"]: x["kind"] for x in audit.classify_columns(df).collect()}
    assert got == {"检查日期": "date", "a": "numeric", "code": "categorical", "得分": "numeric", "t": "text", "c": "categorical"}


def test_missing_bins_are_right_closed(spark):
    df = spark.createDataFrame([(None if i < 5 else 1, None if i < 20 else 1, 1) for i in range(100)], "a int, b int, c int")
    got = {x["bin"]: x["n_columns"] for x in audit.missing_bins(df).collect()}
    assert got["<=5%"] == 2 and got["5-20%"] == 1 and got["95-100%"] == 0


# --- scores ------------------------------------------------------------------------

def test_survey_rules_and_scores(spark):
    columns = {"听力障碍": 1.0, "感知-听力": 0.0, "听力障碍是否影响日常": 1.0, "视力障碍": 0.0, "感知-视力": 1.0, "认知-总分": 30.0,
               "心理-总分": 3.0, "是否焦虑抑郁症": 0.0, "活力-总分": 14.0, "活力-营养描述结果": 2.0, "活力-BMI值": 22.0, "小腿围": 39.0,
               "运动-总分": 12.0, "运动是否完成编码": 2.0, "步态异常-编码": 0.0, "性别": 1.0,
               "运动-4米行走时间：日常行走速度走完4米-平均完成时间": 0.0,
               "Fried衰弱表型评估-握力左手最大值": 20.0, "Fried衰弱表型评估-握力右手最大值": None}
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.createDataFrame([tuple(columns.values()), (None,) * len(columns)], schema)
    out = score.domain_flags(df, survey.RULES, survey.STRATA)
    full, empty = out.collect()
    assert [full[d] for d in presets.DOMAINS] == [1, 0, 1, 0, 0]
    assert [empty[d] for d in presets.DOMAINS] == [0, 0, 0, 0, 0]
    full, empty = score.continuous_scores(df, survey.SCORES).collect()
    assert full["cognition"] == 1.0 and full["vitality"] == pytest.approx(1.0)
    assert full["psychological"] == pytest.approx(0.85 * 0.8 + 0.15)
    # the walking time of zero is unknown, so its weight is spread over the rest
    assert full["locomotion"] == pytest.approx((0.45 + 0.10 + 0.15 + 0.15 * 0.0) / 0.85)
    assert full["sensory"] == pytest.approx(0.5 * 0.0 + 0.5 * 1.0)
    assert empty["cognition"] is None and empty["locomotion"] is None
    # an unknown impairment has full marks for its impact, the one part that is then known
    assert empty["sensory"] == 1.0


def test_levels(spark):
    df = spark.createDataFrame([tuple(int(j < i) for j in range(5)) for i in range(6)], "a int, b int, c int, d int, e int")
    got = [(x["total"], x["level"], x["level_inv"]) for x in score.impairment_total_level(df, df.columns).collect()]
    assert got == [(0, "Low", "High"), (1, "Low", "High"), (2, "Medium", "Medium"), (3, "Medium", "Medium"),
                   (4, "High", "Low"), (5, "High", "Low")]


# --- features ----------------------------------------------------------------------

def test_zscore_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "c double, x double")
    assert rows(features.zscore(df, ["c", "x"])) == [(0.0, -1.0), (0.0, 1.0)]


def test_design_matrix_equals_pandas_style_columns(spark):
    n = 200
    data = [(i, float(i) if i % 20 else None, "rare" if i == 3 else ("a" if i % 2 else "b"), None) for i in range(n)]
    df = spark.createDataFrame(data, "id int, x double, c string, gone string")
    matrix, design = features.design_matrix(df, "id", min_share=0.01)
    assert design.features == ["x", "c=Other", "c=a", "c=b"]
    got = np.array([x["features"].toArray() for x in matrix.orderBy("id").collect()])
    x = np.array([np.nan if d[1] is None else d[1] for d in data])
    x = np.where(np.isnan(x), np.nanmedian(x), x)
    assert got[:, 0] == pytest.approx((x - x.mean()) / x.std())
    assert got[:, 1:].sum(axis=1).tolist() == [1.0] * n and got[3, 1] == 1.0


def test_missing_indicators_in_the_curated_matrix(spark):
    df = spark.createDataFrame([(i, float(i) if i % 15 else None) for i in range(300)], "id int, x double")
    _, design = features.design_matrix(df, "id", curated=True, indicators=True)
    assert design.features == ["x", "x__missing=0", "x__missing=1"]


def test_tfidf_of_tiny_texts(spark):
    df = spark.createDataFrame([(1, "The cat, the cat"), (2, "the dog a"), (3, None)], "id int, t string")
    got = {(x["id"], x["term"]): x for x in features.tfidf_terms(df, "id", "t", min_df=1).collect()}
    assert got[(1, "the cat")]["tf"] == 2 and got[(1, "cat the")]["tf"] == 1 and (2, "a") not in got
    assert got[(1, "the")]["idf"] == pytest.approx(np.log(4 / 3) + 1)
    assert sum(x["weight"] ** 2 for k, x in got.items() if k[0] == 1) == pytest.approx(1.0)


def test_tfidf_vectors_have_the_same_weights(spark):
    df = spark.createDataFrame([(1, "red fox runs"), (2, "red dog sleeps"), (3, "blue fox sleeps")], "id int, t string")
    terms = features.tfidf_terms(df, "id", "t", min_df=1).collect()
    want = {i: sorted(round(x["weight"], 9) for x in terms if x["id"] == i) for i in (1, 2, 3)}
    got = {x["id"]: sorted(round(v, 9) for v in x["features"].values) for x in features.tfidf_vectors(df, "id", "t", min_df=1).collect()}
    assert got == want


# --- embedding and evaluation --------------------------------------------------------

@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -1]])
    data = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.7, 3)], i % 3, float(i % 3) + float(rng.normal(0, 0.1)))
            for i in range(150)]
    data.append((150, [40.0, 40.0, 40.0], 3, 9.0))
    df = spark.createDataFrame(data, "id long, vec array<double>, label int, y double").cache()
    return df, np.array([d[1] for d in data]), np.array([d[2] for d in data])


def test_pca_equals_numpy(spark, blobs):
    df, x, _ = blobs
    got = np.array([r["embedding"].toArray() for r in embed.pca_embed(as_vector(df, "vec"), 2).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2]
    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert got == pytest.approx(centred @ axes.T, abs=1e-8)


@pytest.mark.parametrize("block", [2048, 40])
def test_silhouette_equals_the_definition(spark, blobs, block):
    df, x, labels = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    got = evaluate.silhouette(df, "id", "vec", "label", block_rows=block).first()["silhouette"]
    assert got == pytest.approx(np.mean(want), abs=1e-9)


def test_dispersion_indices_equal_the_definition(spark, blobs):
    df, x, labels = blobs
    ks = sorted(set(labels))
    centres = np.array([x[labels == k].mean(0) for k in ks])
    sizes = np.array([(labels == k).sum() for k in ks])
    between = (sizes * ((centres - x.mean(0)) ** 2).sum(1)).sum()
    within = sum(((x[labels == k] - c) ** 2).sum() for k, c in zip(ks, centres))
    ch = (between / (len(ks) - 1)) / (within / (len(x) - len(ks)))
    s = np.array([np.sqrt(((x[labels == k] - c) ** 2).sum(1)).mean() for k, c in zip(ks, centres)])
    d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))
    db = np.mean([max((s[i] + s[j]) / d[i, j] for j in range(len(ks)) if j != i) for i in range(len(ks))])
    assert evaluate.calinski_harabasz(df, "vec", "label").first()[0] == pytest.approx(ch)
    assert evaluate.davies_bouldin(df, "vec", "label").first()[0] == pytest.approx(db)


def test_agreement_of_trivial_and_renumbered_labelings(spark):
    df = spark.createDataFrame([(0, 0, 2), (0, 0, 2), (0, 1, 0), (0, 1, 0)], "one int, a int, b int")
    assert evaluate.adjusted_rand(df, "one", "one").first()["ari"] == 1.0
    assert evaluate.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    assert evaluate.adjusted_rand(df, "one", "a").first()["ari"] == 0.0
    assert evaluate.normalized_mutual_info(df, "a", "b").first()["nmi"] == pytest.approx(1.0)
    assert evaluate.normalized_mutual_info(df, "one", "one").first()["nmi"] == 1.0


def test_kmeans_rows_sit_with_their_nearest_centre(spark, blobs):
    df, x, _ = blobs
    out = embed.kmeans_labels(as_vector(df, "vec").cache(), 4, n_init=2).orderBy("id").collect()
    labels = np.array([r["cluster"] for r in out])
    centres = np.array([x[labels == k].mean(0) for k in range(4)])
    assert (((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1) == labels).all()


def test_seed_and_bootstrap_stability_of_clear_clusters(spark, blobs):
    df, _, _ = blobs
    ready = as_vector(df.filter("label < 3"), "vec").cache()
    fit = flows.fitter("kmeans", "features", 2)
    base = fit(ready, 3, 1, "cluster")
    assert evaluate.seed_stability(base, "cluster", 3, fit, (0, 1)).first()[0] == pytest.approx(1.0)
    parts = evaluate.subsamples(base, "id", 2)
    assert [p.count() for p in parts] == [120, 120]
    assert evaluate.bootstrap_stability(parts, "cluster", 3, fit).first()[0] == pytest.approx(1.0)
    # one random start may end in a local optimum; the best of the usual five does not
    assert embed.gmm_labels(ready, 3).groupBy("label", "cluster").count().count() == 3


def test_reorder_follows_the_outcome(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 2.0), (3, 9.0), (5, 4.0)], "c int, y double")
    assert rows(embed.reorder_labels(df, "c", "y")) == [(0, 1.0), (0, 2.0), (1, 4.0), (2, 9.0)]


def test_effect_size_of_a_constant(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 3.0)], "g int, c double, x double")
    assert {r["feature"]: r["eta_squared"] for r in evaluate.anova_eta2(df, "g", ["c", "x"]).collect()} == {"c": 0.0, "x": 1.0}
    assert evaluate.external_separation(df, "g", ["c", "x"]).first()["external_separation"] == 0.0


def test_spearman_with_ties_and_gaps(spark):
    x, y = [1, 2, 2, 3, 4, None, 6], [2, 1, 4, 3, 5, 9, None]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    rx, ry = [1, 2.5, 2.5, 4, 5], [2, 1, 4, 3, 5]
    assert evaluate.spearman(df, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    small = evaluate.spearman(df, "x", "y", max_distinct=2).first()
    assert small["n"] == 5 and small["spearman"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


# --- selection: literal metric tables ---------------------------------------------------

GRID_32 = [(2, 0.199181, 0.995173), (3, 0.081698, 0.999698), (4, 0.088154, 0.881405), (5, 0.081343, 0.933518),
           (6, 0.089102, 0.973434), (7, 0.090419, 0.940066), (8, 0.091291, 0.765659), (9, 0.095241, 0.731251), (10, 0.095073, 0.872488)]


def test_best_k_prefers_the_range(spark):
    grid = spark.createDataFrame(GRID_32, "k int, silhouette double, stability_ari double")
    assert evaluate.select_best_k(grid).first()["k"] == 6
    assert evaluate.select_best_k(grid.filter("k > 6 OR k = 2")).first()["k"] == 2


CANDIDATES = [
    ("PCA", "kmeans", 3, 0.109986, 2.517648, 0.990851, 0.223071, 0.224572),
    ("PCA", "kmeans", 4, 0.076994, 2.777851, 0.656434, 0.193361, 0.234876),
    ("PCA", "kmeans", 5, 0.078779, 2.230499, 0.983257, 0.000166, 0.234477),
    ("PCA", "gmm", 4, 0.087129, 5.030686, 0.844447, 0.115353, 0.149632),
    ("Masked", "kmeans", 3, 0.310670, 1.464987, 0.987797, 0.239834, 0.217217),
    ("Masked", "kmeans", 4, 0.237955, 1.532204, 0.991035, 0.210954, 0.230392),
    ("Masked", "gmm", 4, 0.208552, 1.371164, 0.900502, 0.204315, 0.238399),
]
CANDIDATE_SCHEMA = ("method string, clusterer string, k int, silhouette double, davies_bouldin double, stability_ari double, "
                    "min_cluster_ratio double, external_separation double")


def test_weighted_choice(spark):
    grid = spark.createDataFrame(CANDIDATES, CANDIDATE_SCHEMA)
    got = {r["method"]: (r["clusterer"], r["k"], round(r["selection_score"], 4)) for r in evaluate.select_weighted_score(grid).collect()}
    assert got == {"PCA": ("kmeans", 3, 0.3610), "Masked": ("kmeans", 3, 0.4347)}
    ranked = evaluate.method_ranking(grid, evaluate.select_weighted_score(grid)).orderBy("rank").collect()
    assert [r["method"] for r in ranked] == ["PCA", "Masked"]


def test_minmax_choice(spark):
    data = [("PCA32", 3, 0.182200, 1.988848, 0.996320, 0.262108, 0.123239), ("PCA32", 4, 0.159884, 1.987909, 1.0, 0.226623, 0.090436),
            ("PCA32", 5, 0.169665, 1.809229, 1.0, 0.231289, 0.088233), ("PCA32", 6, 0.159506, 2.005195, 0.828944, 0.304224, 0.114771)]
    grid = spark.createDataFrame(data, "method string, k int, silhouette double, davies_bouldin double, stability_ari double, eta2 double, nmi double")
    best = evaluate.select_minmax_score(grid, ["silhouette", "stability_ari", "eta2", "nmi"]).first()
    assert best["k"] == 3 and best["combined_score"] == pytest.approx(0.7028, abs=1e-3)
    one = evaluate.select_minmax_score(grid.limit(1), ["silhouette"]).first()
    assert one["combined_score"] == 0.0


# --- profiles --------------------------------------------------------------------------

def test_kruskal_with_ties(spark):
    a, b, c = [1, 2, 2, 3], [2, 4, 5, 6], [7, 8, 8, 9]
    df = spark.createDataFrame([(g, float(v)) for g, vs in enumerate((a, b, c)) for v in vs], "g int, x double")
    # ranks 1, 3 (x3), 5, 6, 7, 8, 9, 10.5 (x2), 12 with tie correction 1 - 30 / 1716
    h = (12 / (12 * 13) * (12.0 ** 2 + 24.0 ** 2 + 42.0 ** 2) / 4 - 39) / (1 - 30 / 1716)
    got = profile.kruskal_wallis(df, "g", ["x"]).first()
    assert got["h"] == pytest.approx(h) and got["p_value"] == pytest.approx(np.exp(-h / 2))
    assert profile.kruskal_wallis(df, "g", ["x"], max_distinct=3).first()["h"] == pytest.approx(h)


def test_kruskal_edge_cases(spark):
    df = spark.createDataFrame([(0, 1.0, None, 1.0), (1, 1.0, None, None)], "g int, same double, empty double, lone double")
    got = profile.kruskal_wallis(df, "g", ["same", "empty", "lone"]).collect()
    assert [(r["feature"], r["p_value"]) for r in got] == [("same", 1.0)]


def test_fdr_on_middling_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.04, 0.9, 0.0]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r["feature"]: r["q_value_fdr"] for r in profile.bh_fdr(df).collect()}
    want = {"f6": 0.0, "f0": 0.035, "f2": 0.056, "f1": 0.056, "f4": 0.056, "f3": 0.2 * 7 / 6, "f5": 0.9}
    assert got == pytest.approx(want)


def test_cluster_names(spark):
    df = spark.createDataFrame([(0, 1, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)], "c int, a int, b int, d int")
    got = rows(profile.name_clusters(df, "c", {"a": "Sensory", "b": "Locomotion", "d": "Cognition"}))
    assert got == [(0, "Sensory + Locomotion-impaired", "Sensory, Locomotion"), (1, "Low-impairment", "Cognition, Locomotion")]


def test_pseudotime_runs_from_low_to_high(spark, blobs):
    df, _, _ = blobs
    out = profile.pseudotime(df.filter("label < 2"), "id", "vec", "label")
    assert out.agg(F.min("pseudotime")).first()[0] == 0.0
    assert evaluate.spearman(out, "pseudotime", "outcome").first()["spearman"] > 0.8


def test_counterfactual_prefers_large_shifts(spark):
    data = [(1, 0, 0.0, [0.0, 0.0], 1.0, "x"), (2, 0, 0.0, [5.0, 5.0], 9.0, "x"), (3, 1, 5.0, [1.0, 0.0], 8.0, "y"), (4, 1, 6.0, [9.0, 9.0], 8.0, None)]
    df = spark.createDataFrame(data, "id int, c int, y double, v array<double>, a double, k string")
    got = profile.prototype_counterfactual(df, "id", "v", "c", "y", ["a", "k"], n=1).collect()
    assert [(r["query_id"], r["counterfactual_id"], r["top_feature_changes"]) for r in got] == [(3, 1, "a: 8 -> 1 | k: y -> x")]


def test_direction_skips_constant_and_sparse(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0, 1.0, None), (0, 1.0, 3.0, 1.0, 2.0), (1, 9.0, 6.0, 1.0, None)],
                               "c int, y double, x double, same double, gaps double")
    got = profile.direction_table(df, "c", "y", ["x", "same", "gaps"]).collect()
    assert [(r["feature"], r["best_mean"], r["worst_mean"], r["delta"]) for r in got] == [("x", 2.0, 6.0, -4.0)]


# --- prediction --------------------------------------------------------------------------

def test_missing_outcome_counts_as_zero_unless_dropped(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "y double")
    assert [r["low"] for r in predict.quantile_label(df, "y", "low").collect()] == [1, 0, 0, 0, 0]
    assert predict.quantile_label(df, "y", "low", drop_missing=True).count() == 4


def test_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(i, 0 if i % 7 else 1) for i in range(703)], "id long, y int")
    out = predict.stratified_split(df, "id", "y").groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()
    assert all(r["t"] == int(0.2 * r["n"] + 0.5) for r in out)


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_split_of_many_classes_and_none(spark, limit):
    import hashlib
    data = [(i, None if i % 5 == 0 else i % 1201) for i in range(9000)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame(data, "id long, y int")
    got = predict.stratified_split(df, "id", "y", max_distinct=limit)
    key = lambda i: (int(hashlib.md5(f"{i}#42".encode()).hexdigest()[:11], 16), i)
    want = []
    for y in {y for _, y in data}:
        ids = sorted((i for i, c in data if c == y), key=key)
        take = int(0.2 * len(ids) + 0.5)
        # repeated ids at the cut go together
        edge = key(ids[take - 1]) if take else (-1, -1)
        want += [(i, y, int(key(i) <= edge)) for i in ids]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("limit", [2_000_000, 100])
def test_codes_of_many_levels(spark, limit):
    df = spark.createDataFrame([(i, f"v{i * 7919 % 3000}", None if i % 3 else "x") for i in range(3300)], "id int, a string, b string")
    codes = features.category_codes(df, ["a", "b"], max_distinct=limit).collect()
    want = [("a", v, i, 3000) for i, v in enumerate(sorted({f"v{j}" for j in range(3000)}))] + [("b", "x", 0, 1)]
    assert sorted(map(tuple, codes)) == sorted(want)
    place = {v: i for _, v, i, _ in want}
    got = features.encode_categories(df, ["a", "b"]).collect()
    assert len(got) == 3300 and all(r["a"] == place[f"v{r['id'] * 7919 % 3000}"] and r["b"] == (-1 if r["id"] % 3 else 0) for r in got)


def test_prototypes_have_a_place(spark):
    data = [(1, 0, 0.0, [0.0, None], 1.0), (2, 0, 0.0, [5.0, 5.0], 9.0), (3, 1, 5.0, [1.0, 0.0], 8.0), (4, 1, 6.0, None, 8.0), (5, 1, 6.0, [None, 1.0], 2.0)]
    df = spark.createDataFrame(data, "id int, c int, y double, v array<double>, a double")
    got = profile.prototype_counterfactual(df, "id", "v", "c", "y", ["a"]).collect()
    assert [(r["query_id"], r["counterfactual_id"]) for r in got] == [(3, 2)]


def test_binary_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.4), (0, 0, 0.1)], "y int, p int, s double")
    got = predict.binary_metrics(df, "y", "p", "s").first()
    assert (got["accuracy"], got["f1"], got["precision"], got["recall"], got["auc"]) == (0.5, 0.5, 0.5, 0.5, 0.875)
    lone = predict.binary_metrics(df.filter("y = 0"), "y", "p", "s").first()
    assert lone["auc"] is None and lone["recall"] == 0.0


def test_linear_and_permutation_attribution_agree_on_the_driver_of_the_label(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(a), float(b)], float(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = as_vector(spark.createDataFrame(data, "id long, v array<double>, label double"), "v").cache()
    models = predict.train_classifiers(df, trees=10, models=["LR", "RF"])
    linear = predict.model_attribution(df, models["LR"], ["a", "b"]).collect()
    trees = predict.permutation_attribution(df, models["RF"], "id", ["a", "b"], sample=100).collect()
    assert [r["feature"] for r in linear] == ["a", "b"] and [r["feature"] for r in trees] == ["a", "b"]
    swapped = predict.permuted(df, "id", "features")
    assert swapped.count() == 300 and swapped.select("donor").distinct().count() == 300


def test_top_lists_compared(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "feature string, mean_abs double")
    b = spark.createDataFrame([("y", 3.0), ("w", 2.0), ("x", 1.0)], "feature string, mean_abs double")
    assert tuple(predict.leakage_sensitivity(a, b, 2).first()) == (1, 1 / 3)


def test_prediction_flows(spark):
    data = [(i, float(i % 50), float((i * 7) % 13), "a" if i % 2 else "b", i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "id long, outcome double, x double, kind string, cluster int")
    low = flows.predict_low_outcome(df, "id", "outcome", ["cluster"], trees=5, rounds=2).collect()
    assert [r["model"] for r in low] == ["LR", "RF", "GBT"] and all(0 <= r["auc"] <= 1 for r in low)
    by_cluster = flows.predict_clusters(df, "id", "cluster", ["outcome"], trees=5, rounds=2).collect()
    assert all(r["accuracy"] == 1.0 for r in by_cluster)


def test_subtyping_end_to_end(spark):
    data = [(i, float(i % 3) * 10 + (i % 5) * 0.1, float(i % 3), "a" if i % 3 else "b", float(i % 3) * 2 + i % 2) for i in range(90)]
    df = spark.createDataFrame(data, "id long, x double, outcome double, kind string, ext double")
    out = flows.subtype(df, "id", "outcome", ["ext"], 2, {"clusterers": ["kmeans"], "ks": (3,), "n_init": 2, "reps": 1}, curated=True)
    assert out["grid"].count() == 1 and out["assignments"].count() == 90
    profile_rows = out["profile"].orderBy("cluster").collect()
    means = [r["outcome"] for r in profile_rows]
    assert means == sorted(means)


def test_grid_tells_how_clusters_meet_the_outcome(spark):
    data = [(i, float(i % 3) * 10 + (i % 5) * 0.1, float((i * 2) % 3) * 4 + i % 2, i % 3) for i in range(90)]
    df = spark.createDataFrame(data, "id long, x double, outcome double, level int").withColumn("vec", array_to_vector(F.array("x")))
    row = flows.evaluation_grid(df, "id", ["vec"], "outcome", ["x"], ["kmeans"], (3,), n_init=2, reps=1, level="level").first()
    eta = evaluate.anova_eta2(df, "level", ["outcome"]).first()["eta_squared"]
    rank = df.withColumn("place", (F.col("level") * 2) % 3)
    assert row["outcome_eta2"] == pytest.approx(eta) and row["level_nmi"] == pytest.approx(1.0)
    assert row["outcome_spearman"] == pytest.approx(evaluate.spearman(rank, "place", "outcome").first()["spearman"])
    assert row["min_cluster_ratio"] == row["max_cluster_ratio"] == pytest.approx(1 / 3)


def test_contributions_of_a_linear_model(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, None), (3, 5.0, 1.0)], "id int, a double, b double")
    long = predict.linear_contributions(df, "id", {"a": 2.0, "b": -1.0})
    assert {(r["id"], r["feature"]): r["contribution"] for r in long.collect()} == {
        (1, "a"): -4.0, (2, "a"): 0.0, (3, "a"): 4.0, (1, "b"): -2.0, (3, "b"): 2.0}
    got = [(r["feature"], round(r["corr"], 9), r["direction"]) for r in predict.contribution_direction(long).collect()]
    assert got == [("a", 1.0, "positive"), ("b", -1.0, "negative")]


def test_penalty_counts_rows(spark):
    data = [(float(x), 1.0 if x + (x * 7) % 3 > 5 else 0.0) for x in range(-10, 20)]
    df = spark.createDataFrame(data, "x double, label double").withColumn("features", array_to_vector(F.array("x")))
    model = predict.train_classifiers(df, models=["LR"])["LR"]
    w, b = model.coefficients[0], model.intercept
    miss = [(1 / (1 + math.exp(-(w * x + b))) - y, x) for x, y in data]
    # at the optimum of half the squared weight plus the sum of the losses
    assert abs(w + sum(m * x for m, x in miss)) < 1e-2 and abs(sum(m for m, _ in miss)) < 1e-2


def test_survey_leakage_report_and_card(spark):
    df = spark.createDataFrame([(1, 70, 30.0, 2, "x"), (2, None, 10.0, 9, "y")], ["id", "年龄", "认知-总分", "服用药物数量", "其他"])
    assert survey.without_inputs(df).columns == ["id", "年龄", "服用药物数量", "其他"]
    assert "认知-总分" in survey.without_inputs(df, keep=["认知-总分"], functional=True).columns
    assert survey.report(df, ["id"]).columns == ["id", "Age", "Medication count", "Cognition raw score"]
    cards = [r["text_card"] for r in survey.card(df, "id").orderBy("id").collect()]
    assert cards[0] == "Person 1. Demographics: 年龄=70. Burden: 服用药物数量=2. Cognition: 认知-总分=30.0." and "年龄" not in cards[1]
    assert survey.clipped_counts(df).columns == df.columns


def test_few_numbers_among_many_texts(spark):
    for n in (2_000, 8_000):
        df = spark.range(n).select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("remark "), "id")).otherwise((F.col("id") % 3).cast("string")).alias("x"))
        assert audit.classify_columns(df).first()["kind"] == "categorical"


def test_underscore_in_a_group_name_is_no_wildcard(spark):
    names = spark.createDataFrame([("nation",), ("n_orders",), ("a_price",)], "feature string")
    got = {r["feature"]: r["feature_group"] for r in features.assign_groups(names, {}, [("count", ["n_%"]), ("money", ["%price"])]).collect()}
    assert got == {"nation": "other", "n_orders": "count", "a_price": "money"}


def test_a_code_listed_twice(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    book = spark.createDataFrame([("k", "a", "two"), ("k", "a", "one")], "field string, code string, label string")
    assert sorted(map(tuple, clean.codebook_apply(df, book, ["k"]).collect())) == [(1, "one"), (2, "b")]


def test_chi_square_tail_of_many_degrees():
    from cohortry.functions.chi2 import upper_tail
    # Wilson and Hilferty's normal approximation
    for x, k in ((1500, 1200), (1600, 1000), (1301, 1201)):
        z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        assert math.log(upper_tail(x, k)) == pytest.approx(math.log(0.5 * math.erfc(z / math.sqrt(2))), rel=0.01)
    assert upper_tail(3.841458820694124, 1) == pytest.approx(0.05) and upper_tail(5.991464547107979, 2) == pytest.approx(0.05)
