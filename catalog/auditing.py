"""Data audit and rule scores (C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import audit as a
from cohortry.operators import score as s
from cohortry.plans import flows

from . import fixtures as x
from .registry import query, r6, rounded

_COLUMNS = ("id", "nation", "region", "segment", "kind", "sparse_num", "n_orders", "spend_cents", "avg_cents",
            "max_price", "urgent", "finished", "first_date", "bal", "code")
_KEYWORDS = ("price", "cents", "bal")
_LONG = ", ".join(f"{{'c': '{c}', 'v': CAST({c} AS VARCHAR)}}" for c in _COLUMNS)
_FACTS = f"""{x.CLEAN_CTE}, long AS (SELECT UNNEST([{_LONG}], recursive := true) FROM clean),
kinds AS (SELECT c AS "column", CASE
    WHEN c LIKE '%date%' AND COUNT(TRY_CAST(v AS TIMESTAMP)) * 1.0 / COUNT(*) > 0.6 THEN 'date'
    WHEN COUNT(TRY_CAST(v AS DOUBLE)) * 1.0 / COUNT(*) > 0.9 THEN
      CASE WHEN COUNT(DISTINCT TRY_CAST(v AS DOUBLE)) <= 10 AND NOT (c LIKE '%price%' OR c LIKE '%cents%' OR c LIKE '%bal%')
        THEN 'categorical' ELSE 'numeric' END
    WHEN COUNT(DISTINCT v) <= 20 THEN 'categorical' ELSE 'text' END AS kind FROM long GROUP BY c)"""


@query("profile_table", f"""WITH {_FACTS} SELECT (SELECT COUNT(*) FROM clean) AS n_rows, CAST({len(_COLUMNS)} AS BIGINT) AS n_columns,
  (SELECT COUNT(DISTINCT id) FROM clean) AS id_distinct, (SELECT COUNT(*) FROM clean WHERE id IS NULL) AS id_missing,
  COUNT(*) FILTER (kind = 'date') AS n_date, COUNT(*) FILTER (kind = 'numeric') AS n_numeric,
  COUNT(*) FILTER (kind = 'categorical') AS n_categorical, COUNT(*) FILTER (kind = 'text') AS n_text FROM kinds""")
def profile_table(spark, sf):
    return a.profile_table(x.clean(spark, sf), "id", "date", _KEYWORDS)


@query("classify_columns", f'WITH {_FACTS} SELECT "column", kind FROM kinds')
def classify_columns(spark, sf):
    return a.classify_columns(x.clean(spark, sf), "date", _KEYWORDS)


_RATES = """rates AS (SELECT c AS "column", COUNT(*) - COUNT(v) AS n_missing, COUNT(*) AS n_rows,
  (COUNT(*) - COUNT(v)) * 1.0 / COUNT(*) AS missing_rate FROM long GROUP BY c)"""


@query("missing_rate", f"""WITH {_FACTS}, {_RATES} SELECT "column", n_missing, n_rows, CAST(missing_rate AS DOUBLE) AS missing_rate
FROM rates ORDER BY missing_rate DESC, "column" LIMIT 30""")
def missing_rate(spark, sf):
    return a.missing_rate(x.clean(spark, sf), 30)


@query("missing_bins", f"""WITH {_FACTS}, {_RATES}, bins(bin_order, bin, lo, hi) AS (VALUES (0, '<=5%', -1.0, 0.05),
  (1, '5-20%', 0.05, 0.2), (2, '20-50%', 0.2, 0.5), (3, '50-80%', 0.5, 0.8), (4, '80-95%', 0.8, 0.95), (5, '95-100%', 0.95, 1.0))
SELECT bin_order, bin, COUNT("column") AS n_columns FROM bins LEFT JOIN rates ON missing_rate > lo AND missing_rate <= hi
GROUP BY bin_order, bin""")
def missing_bins(spark, sf):
    return a.missing_bins(x.clean(spark, sf))


def _outlier(c: str) -> str:
    return f"""SELECT '{c}' AS field, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.95)')} AS p95,
  {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.99)')} AS p99, CAST(MAX({c}) AS DOUBLE) AS max,
  (SELECT COUNT(*) FROM clean WHERE {c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) FROM clean)) AS n_above_p99 FROM clean"""


@query("outlier_scan", f"WITH {x.CLEAN_CTE} " + " UNION ALL ".join(map(_outlier, ("n_orders", "urgent", "finished", "bal", "max_price"))))
def outlier_scan(spark, sf):
    df = x.clean(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    return rounded(a.outlier_scan(df, ["n_orders", "urgent", "finished", "bal", "max_price", "empty"]), "p95", "p99")


def _range(c: str) -> str:
    return f"""SELECT '{c}' AS field, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
  CASE WHEN MAX({c}) <= 10 THEN '0-10' WHEN MAX({c}) <= 100 THEN '0-100' ELSE 'not_checked' END AS expected_range,
  CASE WHEN MAX({c}) <= 100 THEN COUNT(*) FILTER ({c} < 0 OR {c} > CASE WHEN (SELECT MAX({c}) FROM users) <= 10 THEN 10 ELSE 100 END)
  END AS out_of_range FROM users"""


@query("range_check", f"WITH {x.USERS_CTE} " + " UNION ALL ".join(map(_range, ("n_events", "errors", "purchases", "mean_cents"))))
def range_check(spark, sf):
    return a.range_check(x.users(spark, sf), ["n_events", "errors", "purchases", "mean_cents"])


def _levels(c: str) -> str:
    text = f"COALESCE(CAST({c} AS VARCHAR), 'Missing')"
    return f"""SELECT '{c}' AS field, CASE WHEN {text} IN (SELECT {text} FROM src GROUP BY 1
    HAVING COUNT(*) * 1.0 / (SELECT COUNT(*) FROM src) >= 0.005) THEN {text} ELSE 'Other' END AS level FROM src"""


@query("category_distribution", f"""WITH {x.COHORT_CTE}, src AS (SELECT kind, segment, region, nation, NULLIF(code_raw, 'N/A') AS code_raw FROM cohort),
levels AS ({' UNION ALL '.join(map(_levels, ('kind', 'segment', 'region', 'nation', 'code_raw')))}),
counted AS (SELECT field, level, COUNT(*) AS n FROM levels GROUP BY field, level),
ranked AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY field) AS share,
  ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, level) AS r FROM counted)
SELECT field, level, n, share FROM ranked WHERE r <= 12""")
def category_distribution(spark, sf):
    from cohortry.operators.clean import normalize_missing
    df = normalize_missing(x.cohort(spark, sf).select("kind", "segment", "region", "nation", "code_raw"))
    return a.category_distribution(df, df.columns)


@query("topn_values", f"""WITH {x.DOCS_CTE}, filled AS (SELECT COALESCE(CAST(quality AS VARCHAR), 'Missing') || '/' || source AS v,
  quality IS NULL AS gone FROM docs)
SELECT v AS value, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM filled) AS share,
  CAST(0 AS DOUBLE) AS missing_share FROM filled GROUP BY v ORDER BY n DESC, value LIMIT 15""")
def topn_values(spark, sf):
    df = x.docs(spark, sf).select(F.concat(F.coalesce(F.col("quality").cast("string"), F.lit("Missing")), F.lit("/"), "source").alias("v"))
    return a.topn_values(df, "v", 15)


@query("topn_values_missing", f"""WITH {x.DOCS_CTE}, filled AS (SELECT COALESCE(CAST(quality AS VARCHAR), 'Missing') AS v FROM docs)
SELECT v AS value, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM filled) AS share,
  (SELECT CAST(COUNT(*) FILTER (v = 'Missing') AS DOUBLE) / COUNT(*) FROM filled) AS missing_share
FROM filled GROUP BY v ORDER BY n DESC, value LIMIT 15""")
def topn_values_missing(spark, sf):
    return a.topn_values(x.docs(spark, sf), "quality", 15)


@query("event_month_histogram", f"""WITH {x.CLEAN_CTE}, months AS (SELECT
  strftime(first_date + to_microseconds(CAST(n_orders * 365.25 * 86400000000 AS BIGINT)), '%Y-%m') AS month FROM clean
  WHERE first_date IS NOT NULL AND n_orders IS NOT NULL)
SELECT month, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM months) AS share FROM months GROUP BY month""")
def event_month_histogram(spark, sf):
    return a.event_month_histogram(x.clean(spark, sf), "first_date", "n_orders")


# --- rule scores ---------------------------------------------------------------------

RULES = (
    s.Rule("balance", "bal", "<", 2000), s.Rule("balance", "sparse_num", "<", 5000),
    s.Rule("activity", "n_orders", "<=", 8), s.Rule("activity", "urgent", "==", 0),
    s.Rule("spend", "avg_cents", "<", 23_000_000), s.Rule("spend", "max_price", "<", 400_000),
    s.Rule("backlog", "finished", "<=", 2), s.Rule("coding", "code", ">=", 2), s.Rule("coding", "absent", "==", 1),
)
STRATA = (s.StratumRule("activity", ("urgent", "finished"), "code", {1: 3, 0: 2}),)
DOMAINS = ("balance", "activity", "spend", "backlog", "coding")

_GRIP = ("(COALESCE(code = 1 AND GREATEST(urgent, finished) < 3, FALSE) OR COALESCE(code = 0 AND GREATEST(urgent, finished) < 2, FALSE))")
FLAGS_SQL = f"""flags AS (SELECT *,
  CAST(COALESCE(bal < 2000, FALSE) OR COALESCE(sparse_num < 5000, FALSE) AS INT) AS balance,
  CAST(COALESCE(n_orders <= 8, FALSE) OR COALESCE(urgent = 0, FALSE) OR {_GRIP} AS INT) AS activity,
  CAST(COALESCE(avg_cents < 23000000, FALSE) OR COALESCE(max_price < 400000, FALSE) AS INT) AS spend,
  CAST(COALESCE(finished <= 2, FALSE) AS INT) AS backlog, CAST(COALESCE(code >= 2, FALSE) AS INT) AS coding FROM clean),
levels AS (SELECT *, balance + activity + spend + backlog + coding AS total FROM flags)"""


def flagged(spark, sf):
    return s.impairment_total_level(s.domain_flags(x.clean(spark, sf), RULES, STRATA), DOMAINS)


@query("domain_flags", f"WITH {x.CLEAN_CTE}, {FLAGS_SQL} SELECT id, balance, activity, spend, backlog, coding FROM flags")
def domain_flags(spark, sf):
    return s.domain_flags(x.clean(spark, sf), RULES, STRATA).select("id", *DOMAINS)


@query("grip_by_stratum", f"WITH {x.CLEAN_CTE} SELECT id, CAST({_GRIP} AS INT) AS low FROM clean")
def grip_by_stratum(spark, sf):
    return s.grip_by_stratum(x.clean(spark, sf), ["urgent", "finished"], "code", {1: 3, 0: 2}, "low").select("id", "low")


@query("impairment_total_level", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL} SELECT id, total,
  CASE WHEN total <= 1 THEN 'Low' WHEN total <= 3 THEN 'Medium' ELSE 'High' END AS level,
  CASE WHEN total <= 1 THEN 'High' WHEN total <= 3 THEN 'Medium' ELSE 'Low' END AS level_inv FROM levels""")
def impairment_total_level(spark, sf):
    return flagged(spark, sf).select("id", "total", "level", "level_inv")


@query("impairment_profile", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL} SELECT segment, COUNT(*) AS n_rows,
  CAST(SUM(balance) AS DOUBLE) / COUNT(*) AS balance, CAST(SUM(activity) AS DOUBLE) / COUNT(*) AS activity,
  CAST(SUM(spend) AS DOUBLE) / COUNT(*) AS spend, CAST(SUM(backlog) AS DOUBLE) / COUNT(*) AS backlog,
  CAST(SUM(coding) AS DOUBLE) / COUNT(*) AS coding, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS total,
  CAST(SUM(CASE WHEN total > 3 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS high FROM levels GROUP BY segment""")
def impairment_profile(spark, sf):
    df = x.cohort(spark, sf).withColumnsRenamed({"bal_raw": "bal", "code_raw": "code"})
    return flows.impairment_profile(df, ["bal", "code"], RULES, "segment", STRATA)


_WM = ("(COALESCE(bal, 0) * 0.5 + COALESCE(sparse_num, 0) * 0.3 + COALESCE(code, 0) * 0.2) / NULLIF(CASE WHEN bal IS NULL THEN 0 ELSE 0.5 END "
       "+ CASE WHEN sparse_num IS NULL THEN 0 ELSE 0.3 END + CASE WHEN code IS NULL THEN 0 ELSE 0.2 END, 0)")


@query("weighted_mean_available", f"WITH {x.CLEAN_CTE} SELECT id, {r6(_WM)} AS mean FROM clean")
def weighted_mean_available(spark, sf):
    df = s.weighted_mean_column(x.clean(spark, sf), {"bal": 0.5, "sparse_num": 0.3, "code": 0.2}, "mean")
    return rounded(df.select("id", "mean"), "mean")


SCORES = {
    "volume": s.Linear("n_orders", 1 / 30),
    "wealth": s.Mean(((s.Centered("bal", 5000.0, 5000.0), 0.85), (s.Linear("sparse_num", -1 / 10000, 1.0), 0.15))),
    "pace": s.Speed("urgent", 4.0, 0.4, 0.8),
    "grip": s.StratumScale(("urgent", "finished"), "code", 1, (3.0, 8.0), (2.0, 6.0)),
    "impact": s.Mean(((s.ConditionalImpact("code", "share"), 0.45), (s.Linear("code", -0.5, 1.0, clipped=False), 0.55))),
}


def _c01(v: str) -> str:
    return f"CASE WHEN ({v}) IS NULL THEN NULL ELSE LEAST(GREATEST({v}, 0.0), 1.0) END"


_CENTRE, _SPARSE = _c01("1.0 - ABS(bal - 5000.0) / 5000.0"), _c01("1.0 - sparse_num / 10000.0")
_SCORES_SQL = f"""parts AS (SELECT *, {_CENTRE} AS p1, {_SPARSE} AS p2,
  CASE WHEN code = 1 THEN 1.0 - share ELSE 1.0 END AS p3, 1.0 - 0.5 * code AS p4,
  CASE WHEN code = 1 THEN 3.0 ELSE 2.0 END AS lo, CASE WHEN code = 1 THEN 8.0 ELSE 6.0 END AS hi
  FROM (SELECT *, CAST(finished AS DOUBLE) / n_orders AS share FROM clean)),
scores AS (SELECT id, {_c01('CAST(n_orders AS DOUBLE) / 30.0')} AS volume,
  {_c01('(COALESCE(p1, 0) * 0.85 + COALESCE(p2, 0) * 0.15) / NULLIF(CASE WHEN p1 IS NULL THEN 0 ELSE 0.85 END + CASE WHEN p2 IS NULL THEN 0 ELSE 0.15 END, 0)')} AS wealth,
  {_c01('(4.0 / NULLIF(CAST(urgent AS DOUBLE), 0) - 0.4) / 0.8')} AS pace,
  {_c01('(CAST(GREATEST(urgent, finished) AS DOUBLE) - lo) / (hi - lo)')} AS grip,
  {_c01('(COALESCE(p3, 0) * 0.45 + COALESCE(p4, 0) * 0.55) / NULLIF(CASE WHEN p3 IS NULL THEN 0 ELSE 0.45 END + CASE WHEN p4 IS NULL THEN 0 ELSE 0.55 END, 0)')} AS impact
  FROM parts)"""
_NAMES = tuple(SCORES)


def scored(spark, sf):
    df = x.clean(spark, sf).withColumn("share", F.col("finished").cast("double") / F.col("n_orders"))
    return s.continuous_scores(df, SCORES)


@query("continuous_scores", f"WITH {x.CLEAN_CTE}, {_SCORES_SQL} SELECT id, {', '.join(f'{r6(n, 9)} AS {n}' for n in _NAMES)} FROM scores")
def continuous_scores(spark, sf):
    # prices have two decimals and weights two more: nine places keep half-way cases out
    return rounded(scored(spark, sf).select("id", *_NAMES), *_NAMES, digits=9)


_FILLED = ", ".join(f"COALESCE({n}, (SELECT MEDIAN({n}) FROM scores)) AS {n}" for n in _NAMES)
_TOTAL = f"(({' + '.join(_NAMES)}) / 5.0)"


@query("score_finalize", f"""WITH {x.CLEAN_CTE}, {_SCORES_SQL}, filled AS (SELECT id, {_FILLED} FROM scores)
SELECT id, {', '.join(f'{r6(n, 9)} AS {n}, {r6(n + " * 100.0", 9)} AS {n}_100' for n in _NAMES)},
  {r6(_TOTAL, 9)} AS total, {r6(_TOTAL + ' * 100.0', 9)} AS total_100 FROM filled""")
def score_finalize(spark, sf):
    out = s.score_finalize(scored(spark, sf).select("id", *_NAMES), _NAMES)
    return rounded(out, *[c for c in out.columns if c != "id"], digits=9)


@query("score_conditional_impact", f"""WITH {x.CLEAN_CTE} SELECT id,
  CASE WHEN code = 1 THEN 1.0 - CAST(urgent AS DOUBLE) ELSE 1.0 END AS impact FROM clean""")
def score_conditional_impact(spark, sf):
    return s.score_conditional_impact(x.clean(spark, sf), "code", "urgent", "impact").select("id", "impact")
