"""Prediction and attribution (I)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.vectors import as_vector
from cohortry.operators import boosting
from cohortry.operators import evaluate as g
from cohortry.operators import features as f
from cohortry.operators import predict as p
from cohortry.plans import flows

from . import fixtures as x
from .auditing import _KEYWORDS
from .evaluation import avg_rank, eta_sql
from .registry import query, r6, rounded


@query("quantile_label", f"""WITH {x.CLEAN_CTE} SELECT id, CAST(COALESCE(bal <= (SELECT quantile_cont(bal, 0.25) FROM clean), FALSE) AS INT) AS low_bal,
  CAST(COALESCE(spend_cents <= (SELECT quantile_cont(CAST(spend_cents AS DOUBLE), 0.25) FROM clean), FALSE) AS INT) AS low_spend FROM clean""")
def quantile_label(spark, sf):
    df = p.quantile_label(x.clean(spark, sf), "bal", "low_bal")
    return p.quantile_label(df, "spend_cents", "low_spend").select("id", "low_bal", "low_spend")


@query("stratified_split", f"""WITH {x.DOCS_CTE}, ranked AS (SELECT id, lang, ROW_NUMBER() OVER (PARTITION BY lang
  ORDER BY substr(md5(CAST(id AS VARCHAR) || '#42'), 1, 11), id) AS r, COUNT(*) OVER (PARTITION BY lang) AS n FROM docs)
SELECT id, lang, CAST(r <= FLOOR(0.2 * n + 0.5) AS INT) AS is_test FROM ranked""")
def stratified_split(spark, sf):
    return p.stratified_split(x.docs(spark, sf).select("id", "lang"), "id", "lang")


_PREDICTED = f"""{x.DOCS_CTE}, pred AS (SELECT lang, quality AS y, (n_chars % 97) / 97.0 AS score,
  CAST((n_chars % 97) / 97.0 >= 0.5 AS INT) AS yhat FROM docs WHERE quality IS NOT NULL)"""


@query("binary_metrics", f"""WITH {_PREDICTED}, ranked AS (SELECT *, {avg_rank('score', 'lang')} AS r FROM pred),
s AS (SELECT lang, COUNT(*) AS n, SUM(y) AS p, SUM(yhat) AS hot, SUM(y * yhat) AS tp, SUM(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS ok,
  SUM(r) FILTER (y = 1) AS rs FROM ranked GROUP BY lang)
SELECT lang, n, CAST(ok AS DOUBLE) / n AS accuracy, COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(p + hot, 0), 0) AS f1,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(hot, 0), 0) AS "precision", COALESCE(CAST(tp AS DOUBLE) / NULLIF(p, 0), 0) AS recall,
  {r6('(rs - p * (p + 1) / 2.0) / NULLIF(p * (n - p), 0)')} AS auc FROM s""")
def binary_metrics(spark, sf):
    docs = x.docs(spark, sf).filter("quality IS NOT NULL")
    pred = docs.select("lang", F.col("quality").alias("y"), ((F.col("n_chars") % 97) / 97.0).alias("score")) \
        .withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    return rounded(p.binary_metrics(pred, "y", "yhat", "score", ["lang"]), "auc")


@query("multiclass_metrics", f"""WITH {x.VECTORS_CTE}, pred AS (SELECT label AS y, label2 AS yhat, embedding FROM vectors),
classes AS (SELECT DISTINCT y AS c FROM pred UNION SELECT DISTINCT yhat FROM pred),
per AS (SELECT c, (SELECT COUNT(*) FROM pred WHERE y = c) AS t, (SELECT COUNT(*) FROM pred WHERE yhat = c) AS p,
  (SELECT COUNT(*) FROM pred WHERE y = c AND yhat = c) AS tp FROM classes),
long AS (SELECT c, CAST(y = c AS INT) AS pos, CAST(embedding[c + 1] AS DOUBLE) AS score FROM pred, classes),
ranked AS (SELECT c, pos, {avg_rank('score', 'c')} AS r FROM long),
auc AS (SELECT c, (SUM(r) FILTER (pos = 1) - SUM(pos) * (SUM(pos) + 1) / 2.0) / (SUM(pos) * (COUNT(*) - SUM(pos))) AS auc FROM ranked GROUP BY c)
SELECT CAST(SUM(t) AS BIGINT) AS n, CAST(SUM(tp) AS DOUBLE) / SUM(t) AS accuracy, {r6('AVG(2.0 * tp / (t + p))')} AS f1_macro,
  {r6('AVG(CASE WHEN t > 0 THEN CAST(tp AS DOUBLE) / t END)')} AS balanced_acc, {r6('(SELECT AVG(auc) FROM auc)')} AS auc_ovr FROM per""")
def multiclass_metrics(spark, sf):
    scores = {c: F.col("embedding")[c] for c in range(10)}
    return rounded(p.multiclass_metrics(x.vectors(spark, sf), "label", "label2", scores), "f1_macro", "balanced_acc", "auc_ovr")


@query("train_classifiers")
def train_classifiers(spark, sf):
    rows = as_vector(x.vectors(spark, sf), "embedding").select("id", "features", (F.col("label") >= 5).cast("double").alias("label"))
    ready = p.stratified_split(rows, "id", "label").persist()
    models = p.train_classifiers(ready.filter("is_test = 0"))
    parts = [m.transform(ready.filter("is_test = 1")).select("id", "label", "prediction", F.lit(n).alias("model")) for n, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def _three_classes(spark, sf):
    return as_vector(x.vectors(spark, sf), "embedding").select("id", "features", (F.col("label") % 3).cast("double").alias("label"))


@query("softmax_boosting", f"WITH {x.VECTORS_CTE} SELECT id, CAST(3 AS INT) AS classes, CAST(1 AS DOUBLE) AS total FROM vectors")
def softmax_boosting(spark, sf):
    """Three classes, 300 rounds: every row has a share per class, and the shares make one."""
    rows = _three_classes(spark, sf)
    p_ = vector_to_array("probability")
    return boosting.boost(rows, "label").transform(rows).select(
        "id", F.size(p_).alias("classes"), F.round(F.aggregate(p_, F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


@query("shapley_sums", f"WITH {x.VECTORS_CTE} SELECT id, CAST(0 AS DOUBLE) AS rest FROM vectors")
def shapley_sums(spark, sf):
    """The Shapley values of a row sum to the logarithm of its odds less what the model says where nothing is known."""
    rows = _three_classes(spark, sf).withColumn("label", (F.col("label") == 0).cast("double"))
    model = boosting.boost(rows, "label", rounds=30)
    values = boosting.contributions(rows, model)[0]
    share = vector_to_array("probability")[1]
    odds = F.log(share / (1 - share)) - float(boosting.expectation(model)[0])
    return model.transform(rows.withColumn("values", values)).select(
        "id", (F.round(F.abs(F.aggregate("values", F.lit(0.0), lambda a, v: a + v) - odds), 6) + 0.0).alias("rest"))


@query("tree_attribution")
def tree_attribution(spark, sf):
    rows = _three_classes(spark, sf)
    names = [f"dim{i:02d}" for i in range(64)]
    return rounded(boosting.tree_attribution(rows, boosting.boost(rows, "label", rounds=30), names), "mean_abs")


@query("predict_clusters")
def predict_clusters(spark, sf):
    df = x.clean(spark, sf).drop("first_date")
    zone = F.regexp_extract("nation", r"(\d+)", 1).cast("int") % 3
    return flows.predict_clusters(df.withColumn("cluster", zone), "id", "cluster", ["region"],
                                  design_options={"numeric_keywords": _KEYWORDS})


@query("predict_low_outcome")
def predict_low_outcome(spark, sf):
    df = x.clean(spark, sf).drop("first_date")
    return flows.predict_low_outcome(df, "id", "spend_cents", ["avg_cents"],
                                     design_options={"numeric_keywords": _KEYWORDS})


@query("predict_low_outcome_strict")
def predict_low_outcome_strict(spark, sf):
    df = x.clean(spark, sf).drop("first_date")
    return flows.predict_low_outcome(df, "id", "spend_cents", ["cents", "price", "orders", "urgent", "finished"],
                                     design_options={"numeric_keywords": _KEYWORDS})


_BETA = {"n_orders": 0.5, "urgent": -1.5, "finished": 0.25, "bal": 0.001, "code": 0.8}


@query("feature_attribution", f"WITH {x.CLEAN_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'AVG(ABS({b} * ({c} - (SELECT AVG({c}) FROM clean))))')} AS mean_abs FROM clean" for c, b in _BETA.items()))
def feature_attribution(spark, sf):
    return rounded(p.linear_attribution(x.clean(spark, sf), _BETA), "mean_abs")


def _level_model(spark, sf, models):
    df = x.clean(spark, sf).drop("first_date").withColumn("rich", (F.col("spend_cents") > 300_000_000).cast("int"))
    matrix, design = f.design_matrix(df, "id", keep=["rich"], numeric_keywords=_KEYWORDS)
    ready = matrix.withColumn("label", F.col("rich").cast("double")).persist()
    return ready, design, p.train_classifiers(ready, models=models)


@query("model_attribution")
def model_attribution(spark, sf):
    ready, design, models = _level_model(spark, sf, ["LR"])
    return rounded(p.model_attribution(ready, models["LR"], design.features), "mean_abs", digits=4)


@query("permutation_attribution")
def permutation_attribution(spark, sf):
    ready, design, models = _level_model(spark, sf, ["RF"])
    return rounded(p.permutation_attribution(ready, models["RF"], "id", design.features), "mean_abs", digits=4)


_ALL = ("n_orders", "urgent", "finished", "bal", "max_price", "spend_cents", "avg_cents")
_SAFE = ("n_orders", "urgent", "finished", "bal", "max_price")


@query("leakage_sensitivity", f"""WITH {x.CLEAN_CTE}, a AS ({' UNION ALL '.join(eta_sql(v, 'segment', 'clean') for v in _ALL)}),
b AS ({' UNION ALL '.join(eta_sql(v, 'kind', 'clean') for v in _SAFE)}),
ta AS (SELECT feature FROM a ORDER BY eta DESC, feature LIMIT 3), tb AS (SELECT feature FROM b ORDER BY eta DESC, feature LIMIT 3)
SELECT (SELECT COUNT(*) FROM ta JOIN tb USING (feature)) AS overlap, CAST((SELECT COUNT(*) FROM ta JOIN tb USING (feature)) AS DOUBLE)
  / (SELECT COUNT(*) FROM (SELECT feature FROM ta UNION SELECT feature FROM tb)) AS jaccard""")
def leakage_sensitivity(spark, sf):
    df = x.clean(spark, sf)
    return p.leakage_sensitivity(g.anova_eta2(df, "segment", _ALL), g.anova_eta2(df, "kind", _SAFE), 3, "eta_squared")


@query("attribution_with_and_without")
def attribution_with_and_without(spark, sf):
    df = x.clean(spark, sf).drop("first_date").withColumn("rich", (F.col("spend_cents") > 300_000_000).cast("int"))
    return flows.attribution_with_and_without(df, "id", "rich", ["cents", "n_orders"], 10, {"numeric_keywords": _KEYWORDS})


_DIRECTIONS = {"n_orders": "spend_cents", "urgent": "avg_cents", "bal": "sparse_num", "finished": "max_price", "max_price": "bal"}


@query("attribution_direction", f"""WITH {x.CLEAN_CTE}, r AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature, CORR({a}, {b}) AS c, AVG(ABS({b})) AS m FROM clean" for a, b in _DIRECTIONS.items())})
SELECT feature, {r6('c')} AS corr, CASE WHEN COALESCE(c >= 0, FALSE) THEN 'positive' ELSE 'negative' END AS direction FROM r ORDER BY m DESC, feature LIMIT 4""")
def attribution_direction(spark, sf):
    return rounded(p.attribution_direction(x.clean(spark, sf), _DIRECTIONS, 4), "corr")


@query("contribution_direction", f"WITH {x.CLEAN_CTE}, long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {b} * ({c} - AVG({c}) OVER ()) AS w FROM clean" for c, b in _BETA.items()) + f""")
SELECT feature, {r6('CORR(v, w)')} AS corr, CASE WHEN COALESCE(CORR(v, w) >= 0, FALSE) THEN 'positive' ELSE 'negative' END AS direction
FROM long WHERE v IS NOT NULL GROUP BY feature ORDER BY AVG(ABS(w)) DESC, feature LIMIT 4""")
def contribution_direction(spark, sf):
    return rounded(p.contribution_direction(p.linear_contributions(x.clean(spark, sf), "id", _BETA), 4), "corr")
