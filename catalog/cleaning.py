"""Scans, sinks, cleaning (A, B)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortry.operators import clean as c
from cohortry.sources import tables as t

from . import fixtures as x
from .registry import query, r6, rounded


def _shared(spark) -> str:
    """Where no checkpoint folder is set: the warehouse, which a cluster shares."""
    return spark.conf.get("spark.sql.warehouse.dir")


def _scratch(spark, name: str) -> str:
    """A fresh folder that all executors reach."""
    return f"{t.stage_root(spark, _shared(spark))}/out/{name}-{uuid.uuid4().hex[:12]}"


@query("scan_cohort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def scan_cohort(spark, sf):
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return t.scan_cohort(spark, f"{sf}/customer.parquet", schema, ["c_custkey", "c_mktsegment", "c_acctbal"])


_BY_NATION = """SELECT nation, COUNT(*) AS n_customers, CAST(SUM(spend_cents) AS BIGINT) AS spend_cents
FROM cohort GROUP BY nation"""


@query("scan_artifact", f"WITH {x.COHORT_CTE} {_BY_NATION}")
def scan_artifact(spark, sf):
    report = x.cohort(spark, sf).groupBy("nation").agg(F.count(F.lit(1)).alias("n_customers"), F.sum("spend_cents").alias("spend_cents"))
    path = t.sink_table(report, _scratch(spark, "by_nation"), "csv")
    return t.scan_artifact(spark, path, "nation string, n_customers long, spend_cents long")


@query("sink_table", f"WITH {x.COHORT_CTE} SELECT segment, COUNT(*) AS n, CAST(SUM(n_orders) AS BIGINT) AS n_orders, "
                     "MAX(max_price) AS max_price FROM cohort GROUP BY segment")
def sink_table(spark, sf):
    rows = x.cohort(spark, sf).select("id", "segment", "n_orders", "max_price")
    folder = _scratch(spark, "sheets")
    paths = t.sink_sheets({"sizes": rows.groupBy("segment").count()}, folder)
    stored = t.sink_table(rows, f"{folder}/rows", partition_by=["segment"])
    sizes = spark.read.parquet(paths["sizes"]).withColumnRenamed("count", "n")
    means = spark.read.parquet(stored).groupBy("segment").agg(
        F.sum("n_orders").alias("n_orders"), F.max("max_price").alias("max_price"))
    return sizes.join(means, "segment")


@query("cached_stage", f"WITH {x.CLEAN_CTE} SELECT id, bal, code FROM clean")
def cached_stage(spark, sf):
    inputs = [f"{sf}/{n}.parquet" for n in ("customer", "nation", "region", "orders")]
    stage = lambda: t.cached_stage(spark, "clean_cohort", x.clean(spark, sf).select("id", "bal", "code"),
                                   inputs, {"columns": ["bal", "code"]}, _shared(spark))
    stage()
    return stage()


@query("normalize_missing", f"""WITH {x.COHORT_CTE} SELECT id, kind,
  CASE WHEN UPPER(TRIM(bal_raw)) IN ('ND','UK','NA','N/A','N\\A','N-D','N.D','UNK','UNKNOWN','') THEN NULL ELSE bal_raw END AS bal_raw,
  CASE WHEN UPPER(TRIM(code_raw)) IN ('ND','UK','NA','N/A','N\\A','N-D','N.D','UNK','UNKNOWN','') THEN NULL ELSE code_raw END AS code_raw
FROM cohort""")
def normalize_missing(spark, sf):
    return c.normalize_missing(x.cohort(spark, sf).select("id", "kind", "bal_raw", "code_raw"))


@query("safe_numeric", f"""WITH {x.COHORT_CTE} SELECT id, TRY_CAST(bal_raw AS DOUBLE) AS bal_raw,
  TRY_CAST(code_raw AS DOUBLE) AS code_raw, TRY_CAST(kind AS DOUBLE) AS kind FROM cohort""")
def safe_numeric(spark, sf):
    return c.to_numeric(x.cohort(spark, sf).select("id", "bal_raw", "code_raw", "kind"), ["bal_raw", "code_raw", "kind"])


# whole document texts, and one code block per part; a brand's blocks are read in key order
_BLOCKS = """
SELECT 'label_code' AS form, CAST(doc_id AS STRING) AS field, text AS block, CAST(0 AS BIGINT) AS ord FROM {documents}
UNION ALL SELECT 'code_label', p_brand, CONCAT(LPAD(CAST(p_size AS STRING), 2, '0'), '"', p_type, '",',
    LPAD(CAST(p_partkey % 100 AS STRING), 2, '0'), '"', p_name, '"'), p_partkey FROM {part}
UNION ALL SELECT 'range_code', p_type, CONCAT('<', CAST(p_size * 100 AS STRING), ' ', CAST(p_size % 7 AS STRING), '，',
    CAST(p_size * 100 AS STRING), '-', CAST(p_size * 200 AS STRING), ' ', CAST(p_size % 5 + 10 AS STRING)), p_partkey FROM {part}
"""
_PAIR_SQL = {  # form: (pattern, group of the code, group of the label)
    "label_code": (r"([^0-9,]+?)\s*(\d+)", 2, 1),
    "code_label": r'(\d{1,3})\s*"?([^",]+?)"?(?:,|$)',
    "range_code": (r"([<>≥=\d\-]+)\s*(\d+)", 2, 1),
}


def _pairs_sql(form: str) -> str:
    spec = _PAIR_SQL[form]
    pattern, code, label = spec if isinstance(spec, tuple) else (spec, 1, 2)
    text = "REPLACE(block, '，', ',')"
    if form == "label_code":
        text = f"REGEXP_REPLACE(REPLACE(REPLACE({text}, '、', ' '), '：', ' '), '\\s+', ' ', 'g')"
    return f"""SELECT form, field, ord, UNNEST(regexp_extract_all({text}, '{pattern}', {code})) AS code,
      UNNEST(regexp_extract_all({text}, '{pattern}', {label})) AS label,
      UNNEST(range(len(regexp_extract_all({text}, '{pattern}', {label})))) AS place
    FROM blocks WHERE form = '{form}'"""


@query("codebook_extract", f"""WITH blocks AS ({_BLOCKS.format(documents='documents', part='part')}),
pairs AS ({' UNION ALL '.join(map(_pairs_sql, _PAIR_SQL))}),
ranked AS (SELECT form, field, TRIM(code) AS code, TRIM(label) AS label,
  ROW_NUMBER() OVER (PARTITION BY form, field, TRIM(code) ORDER BY ord DESC, place DESC) AS r
  FROM pairs WHERE TRIM(label) <> '')
SELECT form, field, code, label FROM ranked WHERE r = 1""")
def codebook_extract(spark, sf):
    blocks = spark.sql(_BLOCKS, documents=x.table(spark, sf, "documents"), part=x.table(spark, sf, "part"))
    parts = [c.codebook_extract(blocks.filter(F.col("form") == form), form, order="ord")
             .select(F.lit(form).alias("form"), "field", "code", "label") for form in _PAIR_SQL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# names that end one another and a mark that closes many words, in whole document texts
_FIELDS = ("the", "he", "e", "of", "thanea", "anea", "der", "er", "que", "in")


@query("field_blocks", f"""WITH fields AS (SELECT UNNEST([{', '.join(f"'{n}'" for n in _FIELDS)}]) AS field),
first AS (SELECT doc_id AS id, field, text, instr(text, field || '.') + LENGTH(field) + 1 AS start FROM documents, fields WHERE contains(text, field || '.')),
stops AS (SELECT a.id, a.field, MIN(NULLIF(instr(substr(a.text, a.start), b.field || '.'), 0)) AS stop
  FROM first a JOIN fields b ON a.field <> b.field GROUP BY a.id, a.field)
SELECT id, field, CASE WHEN stop IS NULL THEN substr(text, start) ELSE substr(text, start, stop - 1) END AS block
FROM first JOIN stops USING (id, field)""")
def field_blocks(spark, sf):
    return c.field_blocks(x.table(spark, sf, "documents"), "doc_id", "text", _FIELDS, ".")


@query("codebook_apply", f"""WITH {x.COHORT_CTE},
book AS (SELECT CAST(r_regionkey AS STRING) AS code, r_name AS label FROM region)
SELECT id, COALESCE(b.label, a.code_raw) AS code_raw, COALESCE(d.label, CAST(a.id % 7 AS STRING)) AS week_code
FROM cohort a LEFT JOIN book b ON b.code = TRIM(a.code_raw) LEFT JOIN book d ON d.code = CAST(a.id % 7 AS STRING)""")
def codebook_apply(spark, sf):
    rows = x.cohort(spark, sf).select("id", "code_raw", (F.col("id") % 7).cast("double").alias("week_code"))
    book = x.table(spark, sf, "region").select(F.lit("area").alias("field"), F.col("r_regionkey").cast("string").alias("code"),
                                              F.col("r_name").alias("label"))
    both = c.fan_out(book, {"area": ["code_raw", "week_code"]})
    out = c.codebook_apply(rows, both, ["code_raw", "week_code"])
    # whole codes that have no label stay as they were; the fixture shows them without decimals
    return out.withColumn("week_code", F.regexp_replace("week_code", r"\.0$", ""))


@query("readable_value", f"""WITH {x.CLEAN_CTE}
SELECT id, CASE WHEN bal IS NULL THEN 'missing' WHEN bal = FLOOR(bal) THEN CAST(CAST(bal AS BIGINT) AS VARCHAR)
    ELSE printf('%.2f', bal) END AS bal,
  CASE WHEN code IS NULL THEN 'missing' WHEN code = 0 THEN 'no' WHEN code = 1 THEN 'yes' ELSE '2' END AS code,
  CASE kind WHEN 'ONE' THEN 'first kind' ELSE kind END AS kind,
  CASE WHEN n_orders IS NULL THEN 'missing' ELSE CAST(n_orders AS VARCHAR) END AS n_orders FROM clean""")
def readable_value(spark, sf):
    df = x.clean(spark, sf)
    return df.select("id", c.readable_value(F.col("bal")).alias("bal"), c.readable_value(F.col("code"), flag=True).alias("code"),
                     c.readable_value(F.col("kind"), {"ONE": "first kind"}).alias("kind"),
                     c.readable_value(F.col("n_orders")).alias("n_orders"))


def _clip(v: str, lo: float, hi: float) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL ELSE LEAST(GREATEST(CAST({v} AS DOUBLE), (SELECT quantile_cont({v}, {lo}) FROM clean)), "
            f"(SELECT quantile_cont({v}, {hi}) FROM clean)) END")


@query("winsorize", f"""WITH {x.CLEAN_CTE}
SELECT id, {r6(_clip('max_price', 0.01, 0.99))} AS max_price, {r6(_clip('n_orders', 0.01, 0.99))} AS n_orders,
  {r6(_clip('bal', 0.01, 0.99))} AS bal FROM clean""")
def winsorize(spark, sf):
    df = x.clean(spark, sf).select("id", "max_price", "n_orders", "bal")
    return rounded(c.winsorize(df, ["max_price", "n_orders", "bal"]), "max_price", "n_orders", "bal")


@query("impute_median", f"""WITH {x.CLEAN_CTE} SELECT id,
  {r6('COALESCE(bal, (SELECT MEDIAN(bal) FROM clean))')} AS bal, {r6('COALESCE(code, (SELECT MEDIAN(code) FROM clean))')} AS code,
  {r6('COALESCE(sparse_num, (SELECT MEDIAN(sparse_num) FROM clean))')} AS sparse_num FROM clean""")
def impute_median(spark, sf):
    df = x.clean(spark, sf).select("id", "bal", "code", "sparse_num")
    return rounded(c.impute_median(df, ["bal", "code", "sparse_num"]), "bal", "code", "sparse_num")


@query("missing_indicator", f"""WITH {x.CLEAN_CTE} SELECT id, n_orders,
  CASE WHEN bal IS NULL THEN 1 ELSE 0 END AS bal__missing, CASE WHEN code IS NULL THEN 1 ELSE 0 END AS code__missing,
  CASE WHEN sparse_num IS NULL THEN 1 ELSE 0 END AS sparse_num__missing FROM clean""")
def missing_indicator(spark, sf):
    df = x.clean(spark, sf).select("id", "n_orders", "bal", "code", "sparse_num")
    return c.missing_indicator(df, ["n_orders", "bal", "code", "sparse_num"]).drop("bal", "code", "sparse_num")


def collapse_sql(column: str, share: float) -> str:
    text = f"COALESCE(CAST({column} AS VARCHAR), 'Missing')"
    return (f"CASE WHEN {text} IN (SELECT {text} FROM src GROUP BY 1 HAVING COUNT(*) * 1.0 / (SELECT COUNT(*) FROM src) >= {share}) "
            f"THEN {text} ELSE 'Other' END")


@query("collapse_rare", f"""WITH {x.COHORT_CTE}, src AS (SELECT id, kind, nation, NULLIF(code_raw, 'N/A') AS code_raw FROM cohort)
SELECT id, {collapse_sql('kind', 0.005)} AS kind, {collapse_sql('nation', 0.005)} AS nation,
  {collapse_sql('code_raw', 0.005)} AS code_raw FROM src""")
def collapse_rare(spark, sf):
    df = c.normalize_missing(x.cohort(spark, sf).select("id", "kind", "nation", "code_raw"))
    return c.collapse_rare(df, ["kind", "nation", "code_raw"], 0.005)


@query("drop_sparse_columns", f"""WITH {x.CLEAN_CTE} SELECT id, nation, region, segment, kind, n_orders, spend_cents,
  avg_cents, max_price, urgent, finished, bal, code FROM clean""")
def drop_sparse_columns(spark, sf):
    return c.drop_sparse_columns(x.clean(spark, sf), 0.95, ["first_date"], "IC_")


@query("drop_by_pattern", f"""WITH {x.COHORT_CTE} SELECT id, nation, region, segment, kind, sparse_num, n_orders,
  urgent, finished FROM cohort""")
def drop_by_pattern(spark, sf):
    return c.drop_by_pattern(x.cohort(spark, sf), ["_raw", "cents", "price", "date"])


@query("rename_alias", f"""WITH {x.COHORT_CTE} SELECT id, segment AS "Segment", n_orders AS "Orders",
  max_price AS "Largest order" FROM cohort""")
def rename_alias(spark, sf):
    alias = {"segment": "Segment", "n_orders": "Orders", "absent": "Absent", "max_price": "Largest order"}
    return c.rename_alias(x.cohort(spark, sf), alias, ["id"])
