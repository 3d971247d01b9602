"""Cluster evaluation and selection (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.vectors import as_vector
from cohortry.operators import embed as e
from cohortry.operators import evaluate as g
from cohortry.operators import nearest
from cohortry.plans import flows

from . import fixtures as x
from .feature_queries import embedded
from .registry import query, r6, rounded

_VEC = f"{x.VECTORS_CTE}, vec AS (SELECT id, label, label2, outcome, CAST(embedding AS DOUBLE[]) AS v FROM vectors)"


def _silhouette(label: str, distance: str = "list_distance(p.v, q.v)") -> str:
    return f"""SELECT '{label}' AS labeling, AVG(CASE WHEN size = 1 OR GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS silhouette
  FROM (SELECT id, MAX(CASE WHEN own = other THEN n END) AS size, MAX(CASE WHEN own = other THEN s / NULLIF(n - 1, 0) END) AS a,
    MIN(CASE WHEN own <> other THEN s / n END) AS b FROM (SELECT p.id, p.{label} AS own, q.{label} AS other, SUM({distance}) AS s,
    COUNT(*) AS n FROM vec p, vec q GROUP BY p.id, p.{label}, q.{label}) GROUP BY id)"""


@query("silhouette", f"""WITH {_VEC} SELECT labeling, {r6('silhouette')} AS silhouette FROM ({_silhouette('label')} UNION ALL {_silhouette('label2')})""")
def silhouette(spark, sf):
    return rounded(g.silhouette(x.vectors(spark, sf), "id", "embedding", ["label", "label2"]), "silhouette")


@query("silhouette_squared", f"""WITH {_VEC} SELECT labeling, {r6('silhouette')} AS silhouette FROM (
  {_silhouette('label', 'list_distance(p.v, q.v) * list_distance(p.v, q.v)')} UNION ALL {_silhouette('label2', 'list_distance(p.v, q.v) * list_distance(p.v, q.v)')})""")
def silhouette_squared(spark, sf):
    return rounded(g.silhouette(x.vectors(spark, sf), "id", "embedding", ["label", "label2"], "squared"), "silhouette")


_CENTRES = """long AS (SELECT id, label, UNNEST(v) AS x, UNNEST(range(len(v))) AS pos FROM vec),
centres AS (SELECT label, pos, AVG(x) AS m, COUNT(*) AS n FROM long GROUP BY label, pos)"""


@query("calinski_harabasz", f"""WITH {_VEC}, {_CENTRES}, grand AS (SELECT pos, AVG(x) AS g FROM long GROUP BY pos),
b AS (SELECT SUM(n * (m - g) * (m - g)) AS between, COUNT(DISTINCT label) AS k FROM centres JOIN grand USING (pos)),
w AS (SELECT SUM((x - m) * (x - m)) AS within, COUNT(DISTINCT id) AS n FROM long JOIN centres USING (label, pos))
SELECT {r6('(between / (k - 1)) / (within / (w.n - k))')} AS calinski_harabasz FROM b, w""")
def calinski_harabasz(spark, sf):
    return rounded(g.calinski_harabasz(x.vectors(spark, sf), "embedding", "label"), "calinski_harabasz")


@query("davies_bouldin", f"""WITH {_VEC}, {_CENTRES}, c AS (SELECT label, LIST(m ORDER BY pos) AS c FROM centres GROUP BY label),
s AS (SELECT label, c, AVG(list_distance(v, c)) AS s FROM vec JOIN c USING (label) GROUP BY label, c),
worst AS (SELECT p.label, MAX((p.s + q.s) / list_distance(p.c, q.c)) AS r FROM s p JOIN s q ON p.label <> q.label GROUP BY p.label)
SELECT {r6('AVG(r)')} AS davies_bouldin FROM worst""")
def davies_bouldin(spark, sf):
    return rounded(g.davies_bouldin(x.vectors(spark, sf), "embedding", "label"), "davies_bouldin")


_CELLS = "cells AS (SELECT label AS a, label2 AS b, COUNT(*) AS n FROM vectors GROUP BY label, label2)"


@query("adjusted_rand", f"""WITH {x.VECTORS_CTE}, {_CELLS}, p AS (SELECT SUM(n * (n - 1) / 2.0) AS together, SUM(n) AS n FROM cells),
a AS (SELECT SUM(n * (n - 1) / 2.0) AS s FROM (SELECT SUM(n) AS n FROM cells GROUP BY a)),
b AS (SELECT SUM(n * (n - 1) / 2.0) AS s FROM (SELECT SUM(n) AS n FROM cells GROUP BY b))
SELECT {r6('(together - a.s * b.s / (p.n * (p.n - 1) / 2.0)) / ((a.s + b.s) / 2.0 - a.s * b.s / (p.n * (p.n - 1) / 2.0))')} AS ari FROM p, a, b""")
def adjusted_rand(spark, sf):
    return rounded(g.adjusted_rand(x.vectors(spark, sf), "label", "label2"), "ari")


@query("normalized_mutual_info", f"""WITH {x.VECTORS_CTE}, {_CELLS}, full_cells AS (SELECT n * 1.0 AS n, SUM(n) OVER (PARTITION BY a) * 1.0 AS na,
  SUM(n) OVER (PARTITION BY b) * 1.0 AS nb, SUM(n) OVER () * 1.0 AS t FROM cells),
sums AS (SELECT SUM(n / t * LN(n * t / (na * nb))) AS mi, SUM(-n / t * LN(na / t)) AS ha, SUM(-n / t * LN(nb / t)) AS hb FROM full_cells)
SELECT {r6('mi / ((ha + hb) / 2.0)')} AS nmi FROM sums""")
def normalized_mutual_info(spark, sf):
    return rounded(g.normalized_mutual_info(x.vectors(spark, sf), "label", "label2"), "nmi")


@query("seed_stability")
def seed_stability(spark, sf):
    rows = embedded(spark, sf)
    fit = flows.fitter("kmeans", "features")
    return rounded(g.seed_stability(fit(rows, 5, 42, "cluster"), "cluster", 5, fit), "stability_ari")


@query("bootstrap_stability")
def bootstrap_stability(spark, sf):
    fit = flows.fitter("kmeans", "features")
    rows = fit(embedded(spark, sf), 5, 2026, "cluster")
    return rounded(g.masked_stability(rows, {"cluster": 5}, fit, g.subsample_mask(rows, "id")).select("stability_ari"), "stability_ari")


@query("subsample_sizes", f"""WITH {x.VECTORS_CTE} SELECT CAST(rep AS INT) AS rep, CAST(floor(0.8 * n) AS BIGINT) AS n FROM (SELECT COUNT(*) AS n FROM vectors), range(8) r(rep)""")
def subsample_sizes(spark, sf):
    rows = x.vectors(spark, sf)
    bits = rows.select(g.subsample_mask(rows, "id").alias("m")).select("m", F.explode(F.array(*map(F.lit, range(8)))).alias("rep"))
    return bits.filter(F.expr("shiftright(m, rep) & 1 = 1")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))


def eta_sql(value: str, label: str, source: str) -> str:
    grand = f"(SELECT AVG({value}) FROM {source} WHERE {value} IS NOT NULL)"
    return f"""SELECT '{value}' AS feature, (SELECT COALESCE(SUM(n * (m - {grand}) * (m - {grand})), 0) FROM (SELECT {label}, COUNT({value}) AS n,
    AVG({value}) AS m FROM {source} WHERE {value} IS NOT NULL GROUP BY {label})) / NULLIF(SUM(({value} - {grand}) * ({value} - {grand})), 0) AS eta,
  COUNT({value}) AS n FROM {source}"""


_DOC_VALUES = ("n_chars", "quality", "toxic")


@query("anova_eta2", f"""WITH {x.DOCS_CTE}, etas AS ({' UNION ALL '.join(eta_sql(v, 'lang', 'docs') for v in _DOC_VALUES)})
SELECT feature, {r6('COALESCE(eta, 0)')} AS eta_squared FROM etas""")
def anova_eta2(spark, sf):
    return rounded(g.anova_eta2(x.docs(spark, sf), "lang", _DOC_VALUES), "eta_squared")


_EXTERNAL = ("n_orders", "urgent", "finished", "bal", "max_price", "sparse_num")


@query("external_separation", f"""WITH {x.CLEAN_CTE}, etas AS ({' UNION ALL '.join(eta_sql(v, 'segment', 'clean') for v in _EXTERNAL)})
SELECT {r6('AVG(eta)')} AS external_separation, COUNT(*) AS n_features FROM etas WHERE n >= 30 AND eta IS NOT NULL""")
def external_separation(spark, sf):
    df = x.clean(spark, sf).withColumn("constant", F.lit(2.0)).withColumn("empty", F.lit(None).cast("double"))
    return rounded(g.external_separation(df, "segment", [*_EXTERNAL, "constant", "empty"]), "external_separation")


def avg_rank(value: str, part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    peers = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return f"(RANK() OVER ({by}ORDER BY {value}) + (COUNT(*) OVER ({peers}) - 1) / 2.0)"


@query("spearman", f"""WITH {x.CLEAN_CTE}, long AS (SELECT segment, n_orders AS x, bal AS y FROM clean WHERE n_orders IS NOT NULL AND bal IS NOT NULL),
ranked AS (SELECT segment, {avg_rank('x', 'segment')} AS rx, {avg_rank('y', 'segment')} AS ry FROM long)
SELECT segment, COUNT(*) AS n, {r6('CORR(rx, ry)')} AS spearman FROM ranked GROUP BY segment""")
def spearman(spark, sf):
    return rounded(g.spearman(x.clean(spark, sf), "n_orders", "bal", ["segment"]), "spearman")


@query("cluster_size_balance", f"""WITH {x.VECTORS_CTE}, sizes AS (SELECT label AS cluster, COUNT(*) AS n FROM vectors GROUP BY label),
shares AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER () AS share FROM sizes)
SELECT cluster, n, share, MIN(share) OVER () AS min_share, MAX(share) OVER () AS max_share, n < 50 AS is_small FROM shares""")
def cluster_size_balance(spark, sf):
    return g.cluster_size_balance(x.vectors(spark, sf), "label")


@query("evaluation_grid")
def evaluation_grid(spark, sf):
    rows = as_vector(x.vectors(spark, sf), "embedding", "full")
    both = e.pca_embed(rows, 4, "full", "pca4").select("id", "outcome", "label", "full", "pca4")
    return flows.evaluation_grid(both, "id", ["pca4"], "outcome", ["outcome", "label"], level="label")


_METRICS = ("silhouette", "stability_ari", "external_separation")
_KEYS = "method, clusterer, k"


@query("select_best_k", f"""WITH {x.GRID_CTE}, r AS (SELECT *, k BETWEEN 3 AND 6 AS in_range, ROW_NUMBER() OVER (PARTITION BY method, clusterer
  ORDER BY k BETWEEN 3 AND 6 DESC, silhouette DESC, stability_ari DESC, k) AS r FROM grid)
SELECT {_KEYS}, silhouette, stability_ari, in_range FROM r WHERE r = 1""")
def select_best_k(spark, sf):
    return g.select_best_k(x.grid(spark, sf), ["method", "clusterer"]).select(
        "method", "clusterer", "k", "silhouette", "stability_ari", "in_range")


def _scaled(v: str) -> str:
    lo, hi = f"MIN({v}) OVER (PARTITION BY method)", f"MAX({v}) OVER (PARTITION BY method)"
    return f"CASE WHEN {hi} > {lo} THEN ({v} - {lo}) / ({hi} - {lo}) ELSE 0 END"


_COMBINED = f"""scored AS (SELECT *, ({' + '.join(_scaled(m) for m in (*_METRICS, '(1.0 / (1.0 + davies_bouldin))'))}) / 4.0 AS combined FROM grid)"""


@query("minmax_scores", f"WITH {x.GRID_CTE}, {_COMBINED} SELECT {_KEYS}, {r6('combined')} AS combined_score FROM scored")
def minmax_scores(spark, sf):
    return rounded(g.minmax_scores(x.grid(spark, sf), _METRICS).select("method", "clusterer", "k", "combined_score"), "combined_score")


@query("select_minmax_score", f"""WITH {x.GRID_CTE}, {_COMBINED}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method
  ORDER BY combined DESC, clusterer, k) AS r FROM scored) SELECT {_KEYS}, {r6('combined')} AS combined_score FROM r WHERE r = 1""")
def select_minmax_score(spark, sf):
    best = g.select_minmax_score(x.grid(spark, sf), _METRICS, ties=("clusterer", "k"))
    return rounded(best.select("method", "clusterer", "k", "combined_score"), "combined_score")


_SELECTION = "(0.25 * silhouette + 0.20 * (1.0 / (1.0 + davies_bouldin)) + 0.25 * external_separation + 0.20 * stability_ari + 0.10 * min_cluster_ratio)"
_WEIGHTED = f"""best AS (SELECT * FROM (SELECT *, {_SELECTION} AS selection_score, ROW_NUMBER() OVER (PARTITION BY method
  ORDER BY {_SELECTION} DESC, clusterer, k) AS r FROM grid) WHERE r = 1)"""


@query("select_weighted_score", f"WITH {x.GRID_CTE}, {_WEIGHTED} SELECT {_KEYS}, {r6('selection_score')} AS selection_score FROM best")
def select_weighted_score(spark, sf):
    best = g.select_weighted_score(x.grid(spark, sf)).select("method", "clusterer", "k", "selection_score")
    return rounded(best, "selection_score")


@query("method_ranking", f"""WITH {x.GRID_CTE}, {_WEIGHTED} SELECT {_KEYS}, external_separation, silhouette,
  CAST(ROW_NUMBER() OVER (ORDER BY external_separation DESC, silhouette DESC, {_KEYS}) AS INT) AS rank FROM best""")
def method_ranking(spark, sf):
    grid = x.grid(spark, sf)
    return g.method_ranking(grid, g.select_weighted_score(grid)).select(
        "method", "clusterer", "k", "external_separation", "silhouette", "rank")


@query("pick_finalists", f"""WITH {x.GRID_CTE} SELECT {_KEYS}, silhouette, CASE method WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS finalist FROM grid
WHERE (method = 'R' AND clusterer = 'F' AND k = 4) OR (method = 'A' AND clusterer = 'O' AND k = 4) OR (method = 'N' AND clusterer = 'O' AND k = 3)""")
def pick_finalists(spark, sf):
    chosen = [{"method": "R", "clusterer": "F", "k": 4}, {"method": "A", "clusterer": "O", "k": 4}, {"method": "N", "clusterer": "O", "k": 3}]
    return g.pick_finalists(x.grid(spark, sf), chosen).select("method", "clusterer", "k", "silhouette", "finalist")


@query("metrics_long", f"WITH {x.GRID_CTE} " + " UNION ALL ".join(f"SELECT {_KEYS}, '{m}' AS metric, {m} AS value FROM grid" for m in _METRICS))
def metrics_long(spark, sf):
    return g.metrics_long(x.grid(spark, sf), ["method", "clusterer", "k"], _METRICS)


@query("retrieval_top1", f"""WITH {x.SECOND_VIEW_CTE}, scored AS (SELECT p.id, q.id AS found, ROW_NUMBER() OVER (PARTITION BY p.id
  ORDER BY ROUND(list_cosine_similarity(p.own, q.view), 12) DESC, q.id) AS r FROM second_view p, second_view q)
SELECT COUNT(*) AS n, COUNT(*) FILTER (id = found) AS hits, CAST(COUNT(*) FILTER (id = found) AS DOUBLE) / COUNT(*) AS top1 FROM scored WHERE r = 1""")
def retrieval_top1(spark, sf):
    return g.retrieval_top1(x.vectors(spark, sf).select("id", "embedding"), x.second_view(spark, sf), "id", "embedding", "view")


@query("most_similar", f"""WITH {x.CLEAN_CTE}, rows AS (SELECT id, segment, [CAST(n_orders AS DOUBLE), bal, CAST(urgent AS DOUBLE), CAST(finished AS DOUBLE)] AS v
  FROM clean WHERE n_orders IS NOT NULL AND bal IS NOT NULL AND urgent IS NOT NULL AND finished IS NOT NULL),
scored AS (SELECT p.v AS v, q.id AS found, ROUND(CASE WHEN list_sum([i * i FOR i IN p.v]) * list_sum([i * i FOR i IN q.v]) = 0 THEN 0
  ELSE list_cosine_similarity(p.v, q.v) END, 12) AS s FROM (SELECT DISTINCT v FROM rows WHERE segment = 'MACHINERY') p, rows q WHERE q.segment <> 'MACHINERY')
SELECT v[1] AS n_orders, v[2] AS bal, v[3] AS urgent, v[4] AS finished, {r6('MAX(s)')} AS similarity, arg_min(found, (-s, found)) AS found FROM scored GROUP BY v""")
def most_similar(spark, sf):
    """For the customers of one segment, the most similar customer of the others."""
    rows = x.clean(spark, sf).select("id", "segment", F.array(*[F.col(c).cast("double") for c in ("n_orders", "bal", "urgent", "finished")]).alias("v"))
    own = F.col("segment") == "MACHINERY"
    out = nearest.most_similar(rows.filter(own), rows.filter(~own), "id", "v", "v")
    return rounded(out.select(*[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(("n_orders", "bal", "urgent", "finished"))], "similarity", "found"), "similarity")
