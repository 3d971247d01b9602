"""Profiles, tests, names and counterfactuals of clusters (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import profile as p

from . import fixtures as x
from .auditing import DOMAINS, FLAGS_SQL, flagged
from .evaluation import avg_rank, eta_sql
from .registry import query, r6, rounded

_TESTED = ("n_orders", "urgent", "finished", "bal", "max_price")


@query("cluster_profile_means", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL} SELECT segment, COUNT(*) AS n_rows, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS total,
  CAST(SUM(n_orders) AS DOUBLE) / COUNT(n_orders) AS n_orders, {r6('AVG(bal)')} AS bal, {r6('AVG(sparse_num)')} AS sparse_num FROM levels GROUP BY segment""")
def cluster_profile_means(spark, sf):
    return rounded(p.cluster_profile_means(flagged(spark, sf), "segment", ["total", "n_orders", "bal", "sparse_num"]), "bal", "sparse_num")


def _long(columns) -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, segment AS label, CAST({c} AS DOUBLE) AS value FROM clean WHERE {c} IS NOT NULL" for c in columns) + ")"


_KRUSKAL = f"""{_long(_TESTED)}, ranked AS (SELECT *, {avg_rank('value', 'feature')} AS r, COUNT(*) OVER (PARTITION BY feature, value) * 1.0 AS t FROM long),
grouped AS (SELECT feature, label, COUNT(*) * 1.0 AS n, SUM(r) AS r, AVG(value) AS m, SUM(t * t - 1.0) AS t FROM ranked GROUP BY feature, label),
whole AS (SELECT feature, SUM(n) AS n, COUNT(*) AS n_groups, SUM(r * r / n) AS q, SUM(t) AS t, MAX(m) - MIN(m) AS max_mean_diff FROM grouped GROUP BY feature),
stat AS (SELECT *, (12.0 / (n * (n + 1)) * q - 3.0 * (n + 1)) / (1.0 - t / (n * n * n - n)) AS h FROM whole),
tests AS (SELECT feature, CAST(n AS BIGINT) AS n, n_groups, h, EXP(-h / 2.0) * (1.0 + h / 2.0) AS p_value, max_mean_diff FROM stat)"""


# five segments leave four degrees of freedom, where the chi-square tail has a closed form
@query("kruskal_wallis", f"""WITH {x.CLEAN_CTE}, {_KRUSKAL} SELECT feature, n, n_groups, {r6('h')} AS h, {r6('p_value')} AS p_value,
  {r6('max_mean_diff')} AS max_mean_diff FROM tests""")
def kruskal_wallis(spark, sf):
    return rounded(p.kruskal_wallis(x.clean(spark, sf), "segment", _TESTED), "h", "p_value", "max_mean_diff")


_FDR = """fdr AS (SELECT *, LEAST(1.0, MIN(s) OVER (ORDER BY p_value, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value_fdr
  FROM (SELECT *, p_value * COUNT(*) OVER () / ROW_NUMBER() OVER (ORDER BY p_value, feature) AS s FROM tests))"""


@query("bh_fdr", f"WITH {x.CLEAN_CTE}, {_KRUSKAL}, {_FDR} SELECT feature, {r6('p_value')} AS p_value, {r6('q_value_fdr')} AS q_value_fdr FROM fdr")
def bh_fdr(spark, sf):
    tests = p.kruskal_wallis(x.clean(spark, sf), "segment", _TESTED).select("feature", "p_value")
    return rounded(p.bh_fdr(tests), "p_value", "q_value_fdr")


@query("external_stats_table", f"""WITH {x.CLEAN_CTE}, {_KRUSKAL}, {_FDR}, etas AS ({' UNION ALL '.join(eta_sql(v, 'segment', 'clean') for v in _TESTED)})
SELECT feature, fdr.n, n_groups, {r6('h')} AS h, {r6('p_value')} AS p_value, {r6('q_value_fdr')} AS q_value_fdr, {r6('eta')} AS eta_squared,
  {r6('max_mean_diff')} AS max_mean_diff FROM fdr JOIN etas USING (feature)""")
def external_stats_table(spark, sf):
    return rounded(p.external_stats_table(x.clean(spark, sf), "segment", _TESTED), "h", "p_value", "q_value_fdr", "eta_squared", "max_mean_diff")


_LANGS = ("de", "en", "es", "fr")
_MARKERS = ("n_chars", "quality", "toxic")


@query("top_markers", f"""WITH {x.DOCS_CTE}, etas AS ({' UNION ALL '.join(eta_sql(v, 'lang', 'docs') for v in _MARKERS)}),
means AS ({' UNION ALL '.join(f"SELECT '{v}' AS feature, " + ', '.join(f"CAST(SUM({v}) FILTER (lang = '{c}') AS DOUBLE) / COUNT({v}) FILTER (lang = '{c}') AS cluster_{c}_mean" for c in _LANGS) + " FROM docs" for v in _MARKERS)})
SELECT feature, {r6('eta')} AS eta_squared, {', '.join(f"cluster_{c}_mean" for c in _LANGS)} FROM etas JOIN means USING (feature) WHERE n >= 50""")
def top_markers(spark, sf):
    return rounded(p.top_markers(x.docs(spark, sf), "lang", _MARKERS, _LANGS), "eta_squared")


_MEAN = {d: f"CAST(SUM({d}) AS DOUBLE) / COUNT(*)" for d in (*DOMAINS, "total")}


@query("name_clusters", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, long AS ({' UNION ALL '.join(
    f"SELECT segment AS label, '{d.capitalize()}' AS name, {_MEAN[d]} AS m FROM levels GROUP BY segment" for d in DOMAINS)}),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY m DESC, name) AS r FROM long)
SELECT label, CASE WHEN AVG(m) < 0.2 THEN 'Low-impairment' ELSE STRING_AGG(name, ' + ' ORDER BY r) || '-impaired' END AS cluster_name,
  STRING_AGG(name, ', ' ORDER BY r) AS top_domains FROM best WHERE r <= 2 GROUP BY label""")
def name_clusters(spark, sf):
    return p.name_clusters(flagged(spark, sf), "segment", {d: d.capitalize() for d in DOMAINS})


_PCT = {d: f"100.0 * SUM({d}) / COUNT(*)" for d in DOMAINS}


@query("cluster_interpretation", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, prof AS (SELECT segment, {_MEAN['total']} AS total, {_MEAN['balance']} AS balance,
  {_MEAN['coding']} AS coding, {_MEAN['spend']} AS spend, AVG(n_orders) AS n_orders, AVG(bal) AS bal FROM levels GROUP BY segment),
t AS (SELECT *, concat_ws(', ', CASE WHEN balance < 0.15 THEN 'balances hold' WHEN balance > 0.25 THEN 'balances are low' END,
  CASE WHEN coding > 0.3 THEN 'coding is high' END, CASE WHEN spend < 0.5 THEN 'spending holds' END) AS traits FROM prof)
SELECT segment, concat_ws(' ', printf('Cluster %s: total=%.1f.', segment, total), CASE WHEN total < 1.2 THEN 'Least impaired.'
  WHEN total > 1.9 THEN 'Most impaired.' ELSE 'In between.' END, CASE WHEN traits <> '' THEN 'Traits: ' || traits || '.' END,
  printf('Outcomes: Orders=%.2f, Balance=%.1f.', n_orders, bal)) AS interpretation FROM t""")
def cluster_interpretation(spark, sf):
    profile = p.cluster_profile_means(flagged(spark, sf), "segment", ["total", "balance", "coding", "spend", "n_orders", "bal"])
    return p.cluster_interpretation(
        profile, "segment", "total", (1.2, "Least impaired.", "In between.", 1.9, "Most impaired."),
        [("balance", 0.15, "balances hold", 0.25, "balances are low"), ("coding", None, None, 0.3, "coding is high"),
         ("spend", 0.5, "spending holds", None, None)],
        [("n_orders", "Orders", 2), ("bal", "Balance", 1), ("absent", "Absent", 1)])


_OUT = ("n_orders", "urgent", "finished")


@query("gradient_summary", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, means AS (SELECT segment, {', '.join(f'{v} AS {k}' for k, v in _MEAN.items())},
  {', '.join(f"CAST(SUM({o}) AS DOUBLE) / COUNT({o}) AS {o}" for o in _OUT)} FROM levels GROUP BY segment),
ordered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total, segment) AS o FROM means),
long AS ({' UNION ALL '.join(f"SELECT '{v}' AS outcome, o, {v} AS v FROM ordered" for v in _OUT)}),
ranked AS (SELECT outcome, o, v, {avg_rank('o', 'outcome')} AS ro, {avg_rank('v', 'outcome')} AS rv FROM long),
spans AS ({' UNION ALL '.join(f"SELECT '{d}' AS d, {i} AS i, MAX({d}) - MIN({d}) AS r FROM means" for i, d in enumerate(DOMAINS))}),
top AS (SELECT d, r FROM spans ORDER BY r DESC, i LIMIT 1)
SELECT outcome, arg_min(v, o) AS worst_value, arg_max(v, o) AS best_value, {r6('CORR(ro, rv)')} AS order_spearman,
  (SELECT d FROM top) AS top_domain, {r6('(SELECT r FROM top)')} AS top_range FROM ranked GROUP BY outcome""")
def gradient_summary(spark, sf):
    return rounded(p.gradient_summary(flagged(spark, sf), "segment", "total", DOMAINS, _OUT), "order_spearman", "top_range")


_VEC = f"{x.VECTORS_CTE}, vec AS (SELECT id, label, outcome, CAST(embedding AS DOUBLE[]) AS v FROM vectors)"
_AXIS = """cuts AS (SELECT quantile_cont(outcome, 0.25) AS lo, quantile_cont(outcome, 0.75) AS hi FROM vec),
elements AS (SELECT id, outcome, UNNEST(v) AS x, UNNEST(range(len(v))) AS pos FROM vec),
axis AS (SELECT pos, AVG(x) FILTER (outcome <= lo) AS a, AVG(x) FILTER (outcome >= hi) AS b FROM elements, cuts GROUP BY pos),
placed AS (SELECT id, outcome, SUM((x - a) * (b - a)) / ((SELECT SUM((b - a) * (b - a)) FROM axis) + 1e-8) AS t
  FROM elements JOIN axis USING (pos) GROUP BY id, outcome)"""


@query("pseudotime", f"""WITH {_VEC}, {_AXIS} SELECT id, CAST(outcome AS DOUBLE) AS outcome,
  {r6('(t - MIN(t) OVER ()) / (MAX(t) OVER () - MIN(t) OVER () + 1e-8)')} AS pseudotime FROM placed""")
def pseudotime(spark, sf):
    return rounded(p.pseudotime(x.vectors(spark, sf), "id", "embedding", "outcome"), "pseudotime")


@query("pseudotime_spearman", f"""WITH {_VEC}, {_AXIS}, r AS (SELECT {avg_rank('t')} AS a, {avg_rank('outcome')} AS b FROM placed)
SELECT COUNT(*) AS n, {r6('CORR(a, b)')} AS spearman FROM r""")
def pseudotime_spearman(spark, sf):
    from cohortry.operators.evaluate import spearman
    return rounded(spearman(p.pseudotime(x.vectors(spark, sf), "id", "embedding", "outcome"), "pseudotime", "outcome"), "spearman")


@query("cluster_medoids", f"""WITH {_VEC}, elements AS (SELECT id, label, UNNEST(v) AS x, UNNEST(range(len(v))) AS pos FROM vec),
centres AS (SELECT label, pos, AVG(x) AS m FROM elements GROUP BY label, pos),
near AS (SELECT label, id, SUM((x - m) * (x - m)) AS d FROM elements JOIN centres USING (label, pos) GROUP BY label, id),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY d, id) AS place FROM near)
SELECT label, id, {r6('d')} AS distance2, CAST(place AS INT) AS place FROM placed WHERE place <= 3""")
def cluster_medoids(spark, sf):
    return rounded(p.cluster_medoids(x.vectors(spark, sf), "id", "embedding", "label", 3), "distance2")


_FIELDS = ("n_orders", "urgent", "finished", "max_price", "bal", "code", "kind", "region")
_NUMERIC = _FIELDS[:6]
_TEXT = {c: f"CASE WHEN {{0}}.{c} IS NULL THEN 'missing' WHEN {{0}}.{c} = FLOOR({{0}}.{c}) THEN CAST(CAST({{0}}.{c} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', CAST({{0}}.{c} AS DOUBLE)) END"
         if c in _NUMERIC else f"{{0}}.{c}" for c in _FIELDS}


def _difference(i: int, c: str) -> str:
    text = f"'{c}: ' || {_TEXT[c].format('q')} || ' -> ' || {_TEXT[c].format('c')}"
    if c in _NUMERIC:
        size = (f"CASE WHEN q.{c} IS NOT NULL AND c.{c} IS NOT NULL THEN ABS(CAST(q.{c} AS DOUBLE) - c.{c}) / ((SELECT stddev_samp({c}) FROM space) + 1e-6) "
                f"WHEN q.{c} IS DISTINCT FROM c.{c} THEN 1.0 END")
    else:
        size = f"CASE WHEN q.{c} <> c.{c} THEN 1.0 END"
    return f"SELECT m.place, {i} AS i, {size} AS size, {text} AS txt FROM matched m JOIN space q ON q.id = m.qid JOIN space c ON c.id = m.cid"


@query("prototype_counterfactual", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, space AS (SELECT *, max_price / 100000.0 AS scaled FROM levels),
means AS (SELECT segment, AVG(total) AS m FROM space GROUP BY segment),
worst AS (SELECT segment FROM means ORDER BY m DESC, segment DESC LIMIT 1), best AS (SELECT segment FROM means ORDER BY m, segment LIMIT 1),
centre AS (SELECT AVG(n_orders) AS a, AVG(urgent) AS b, AVG(finished) AS c, AVG(scaled) AS d FROM space WHERE segment = (SELECT segment FROM worst)),
medoid AS (SELECT id, n_orders, urgent, finished, scaled, ROW_NUMBER() OVER (ORDER BY (n_orders - a) * (n_orders - a) + (urgent - b) * (urgent - b)
    + (finished - c) * (finished - c) + (scaled - d) * (scaled - d), id) AS place FROM space, centre WHERE segment = (SELECT segment FROM worst)),
near AS (SELECT m.place, m.id AS qid, s.id AS cid, ROW_NUMBER() OVER (PARTITION BY m.place ORDER BY (m.n_orders - s.n_orders) * (m.n_orders - s.n_orders)
    + (m.urgent - s.urgent) * (m.urgent - s.urgent) + (m.finished - s.finished) * (m.finished - s.finished) + (m.scaled - s.scaled) * (m.scaled - s.scaled), s.id) AS r
  FROM medoid m JOIN space s ON s.segment = (SELECT segment FROM best) WHERE m.place <= 3),
matched AS (SELECT * FROM near WHERE r = 1), diffs AS ({' UNION ALL '.join(_difference(i, c) for i, c in enumerate(_FIELDS))}),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY place ORDER BY size DESC, i) AS r FROM diffs WHERE size IS NOT NULL)
SELECT m.qid AS query_id, q.segment AS query_cluster, q.total AS query_outcome, m.cid AS counterfactual_id, c.segment AS counterfactual_cluster,
  c.total AS counterfactual_outcome, (SELECT STRING_AGG(txt, ' | ' ORDER BY r) FROM top WHERE top.place = m.place AND r <= 6) AS top_feature_changes
FROM matched m JOIN space q ON q.id = m.qid JOIN space c ON c.id = m.cid""")
def prototype_counterfactual(spark, sf):
    df = flagged(spark, sf)
    place = F.array(*[F.col(c).cast("double") for c in ("n_orders", "urgent", "finished")], F.col("max_price") / 100000.0)
    return p.prototype_counterfactual(df.withColumn("v", place), "id", "v", "segment", "total", _FIELDS)


def _direction(c: str) -> str:
    return f"""SELECT '{c}' AS feature, AVG({c}) FILTER (segment = (SELECT segment FROM best)) AS h, AVG({c}) FILTER (segment = (SELECT segment FROM worst)) AS w,
  stddev_samp({c}) AS sd, COUNT({c}) * 1.0 / COUNT(*) AS present FROM levels"""


_DIRECTED = ("n_orders", "urgent", "finished", "max_price", "bal", "code", "sparse_num")


@query("direction_table", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, means AS (SELECT segment, AVG(total) AS m FROM levels GROUP BY segment),
worst AS (SELECT segment FROM means ORDER BY m DESC, segment DESC LIMIT 1), best AS (SELECT segment FROM means ORDER BY m, segment LIMIT 1),
d AS ({' UNION ALL '.join(map(_direction, _DIRECTED))})
SELECT feature, {r6('h')} AS best_mean, {r6('w')} AS worst_mean, {r6('h - w')} AS delta, {r6('(h - w) / (sd + 1e-8)')} AS standardized_delta
FROM d WHERE present >= 0.7 AND sd > 0""")
def direction_table(spark, sf):
    df = flagged(spark, sf).withColumn("constant", F.lit(1))
    return rounded(p.direction_table(df, "segment", "total", [*_DIRECTED, "constant"]), "best_mean", "worst_mean", "delta", "standardized_delta")
