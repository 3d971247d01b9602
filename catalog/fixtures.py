"""Cohort-shaped tables derived from the given tables, by the same SQL on both sides.

The given tables have no missing values, so the cohort gets missing tokens in a
column by key arithmetic; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.vectors import doubles

COHORT = """
SELECT c.c_custkey AS id, n.n_name AS nation, r.r_name AS region, c.c_mktsegment AS segment,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'ND' WHEN c.c_custkey % 17 = 0 THEN ' uk '
       WHEN c.c_custkey % 19 = 0 THEN '' ELSE CAST(c.c_acctbal AS STRING) END AS bal_raw,
  CASE WHEN c.c_custkey % 11 = 0 THEN 'N/A' ELSE CAST(c.c_custkey % 3 AS STRING) END AS code_raw,
  CASE WHEN c.c_custkey % 7 = 0 THEN 'ONE' WHEN c.c_custkey % 251 = 0 THEN 'RARE' ELSE 'TWO' END AS kind,
  CASE WHEN c.c_custkey % 29 <> 0 THEN NULL ELSE c.c_acctbal END AS sparse_num,
  o.n_orders, o.spend_cents, o.avg_cents, o.max_price, o.urgent, o.finished, o.first_date
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders,
    CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spend_cents,
    CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS avg_cents,
    MAX(o_totalprice) AS max_price,
    CAST(SUM(CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent,
    CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished,
    MIN(o_orderdate) AS first_date
  FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""

# the same cohort with tokens removed and text read as numbers
CLEAN = """
SELECT id, nation, region, segment, kind, sparse_num, n_orders, spend_cents, avg_cents, max_price, urgent,
  finished, first_date,
  CASE WHEN UPPER(TRIM(bal_raw)) IN ('ND','UK','NA','N/A','') THEN NULL ELSE TRY_CAST(bal_raw AS DOUBLE) END AS bal,
  CASE WHEN UPPER(TRIM(code_raw)) IN ('ND','UK','NA','N/A','') THEN NULL ELSE TRY_CAST(code_raw AS DOUBLE) END AS code
FROM cohort
"""

DOCS = """
SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

VECTORS = """
SELECT vec_id AS id, embedding, label, CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS label2,
  CAST(label + vec_id % 4 AS INT) AS outcome
FROM {embeddings}
"""

USERS = """
SELECT user_id AS id, COUNT(*) AS n_events,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS mean_cents,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
  MIN(ts) AS first_ts, MAX(ts) AS last_ts
FROM {events} GROUP BY user_id
"""

# one row per candidate (method, clusterer, k), with metrics taken over all line items
GRID = """
SELECT l_returnflag AS method, l_linestatus AS clusterer, CAST(l_linenumber + 1 AS INT) AS k,
  CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS silhouette,
  CAST(SUM(CAST(ROUND(l_quantity) AS BIGINT)) AS DOUBLE) / COUNT(*) AS davies_bouldin,
  CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS stability_ari,
  CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS min_cluster_ratio,
  CAST(SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS external_separation
FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber
"""

#: schemas are given, so that no file is opened before a query runs
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
_DUCK = {t: t for t in SCHEMAS}

#: CTE bodies for the oracle side
COHORT_CTE = f"cohort AS ({COHORT.format(**_DUCK)})"
CLEAN_CTE = f"{COHORT_CTE}, clean AS ({CLEAN})"
DOCS_CTE = f"docs AS ({DOCS.format(**_DUCK)})"
VECTORS_CTE = f"vectors AS ({VECTORS.format(**_DUCK)})"
USERS_CTE = f"users AS ({USERS.format(**_DUCK)})"
GRID_CTE = f"grid AS ({GRID.format(**_DUCK)})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _derived(sql: str):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        used = {t: table(spark, sf, t) for t in SCHEMAS if "{" + t + "}" in sql}
        return spark.sql(sql, **used)
    return build


cohort = _derived(COHORT)
docs = _derived(DOCS)
vectors = _derived(VECTORS)
users = _derived(USERS)
grid = _derived(GRID)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cohort after the library's own cleaning operators."""
    from cohortry.operators.clean import normalize_missing, to_numeric
    tidy = to_numeric(normalize_missing(cohort(spark, sf)), ["bal_raw", "code_raw"])
    return tidy.withColumnsRenamed({"bal_raw": "bal", "code_raw": "code"})


def second_view(spark: SparkSession, sf: str) -> DataFrame:
    """(id, view): each vector averaged with its successor's, as a second view of the same rows."""
    # the join shuffles the vectors as they are stored
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("own"))
    after = v.select((F.col("id") - 1).alias("id"), F.col("own").alias("next"))
    mean = F.zip_with(doubles("own"), doubles("next"), lambda a, b: (a + b) / 2.0)
    return v.join(after, "id", "left").select("id", F.coalesce(mean, doubles("own")).alias("view"))


SECOND_VIEW_CTE = """
own AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS own FROM embeddings),
second_view AS (SELECT a.id, a.own, CASE WHEN b.own IS NULL THEN a.own
    ELSE [(p[1] + p[2]) / 2.0 FOR p IN list_zip(a.own, b.own)] END AS view
  FROM own a LEFT JOIN own b ON b.id = a.id + 1)
"""
