"""Feature preparation, embedding and clustering (E, F)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from cohortry.functions.vectors import as_vector, norm
from cohortry.operators import embed as e
from cohortry.operators import features as f
from cohortry.operators import indicators as s
from cohortry.operators.clean import collapse_rare, readable_value

from . import fixtures as x
from .auditing import DOMAINS, FLAGS_SQL, _COLUMNS, _FACTS, _KEYWORDS, flagged
from .registry import query, r6, rounded


@query("split_feature_types", f"""WITH {_FACTS}, wide AS (SELECT c AS "column", CASE
    WHEN COUNT(TRY_CAST(v AS DOUBLE)) * 1.0 / COUNT(*) > 0.9 AND (COUNT(DISTINCT TRY_CAST(v AS DOUBLE)) > 10
      OR c LIKE '%price%' OR c LIKE '%cents%' OR c LIKE '%bal%') THEN 'numeric'
    WHEN COUNT(DISTINCT v) <= 20 THEN 'categorical'
    WHEN COUNT(TRY_CAST(v AS DOUBLE)) * 1.0 / COUNT(*) > 0.5 THEN 'numeric' ELSE 'categorical' END AS kind,
  CASE WHEN c = 'code' THEN 'numeric' WHEN COUNT(TRY_CAST(v AS DOUBLE)) * 1.0 / COUNT(*) > 0.9
      AND COUNT(DISTINCT TRY_CAST(v AS DOUBLE)) > 10 THEN 'numeric' ELSE 'categorical' END AS curated FROM long GROUP BY c)
SELECT * FROM wide""")
def split_feature_types(spark, sf):
    df = x.clean(spark, sf)
    wide = f.feature_types_table(df, numeric_keywords=_KEYWORDS)
    return wide.join(f.feature_types_table(df, curated=True, always_numeric=["code"])
                     .withColumnRenamed("kind", "curated"), "column")


def _z(c: str) -> str:
    return r6(f"({c} - (SELECT AVG({c}) FROM clean)) / COALESCE(NULLIF((SELECT stddev_pop({c}) FROM clean), 0), 1)") + f" AS {c}"


@query("zscore", f"WITH {x.CLEAN_CTE} SELECT id, {_z('n_orders')}, {_z('max_price')}, {_z('bal')}, 0.0::DOUBLE AS constant FROM clean")
def zscore(spark, sf):
    df = x.clean(spark, sf).select("id", "n_orders", "max_price", "bal", F.lit(3.0).alias("constant"))
    return rounded(f.zscore(df, ["n_orders", "max_price", "bal", "constant"]), "n_orders", "max_price", "bal")


def _dummy(c: str) -> str:
    return f"SELECT id, '{c}=' || level AS feature, CAST({c} = level AS INT) AS value FROM cohort, (SELECT DISTINCT {c} AS level FROM cohort)"


# in long form, since the columns depend on the levels that occur
@query("one_hot", f"WITH {x.COHORT_CTE} {_dummy('kind')} UNION ALL {_dummy('segment')}")
def one_hot(spark, sf):
    wide = f.one_hot(x.cohort(spark, sf).select("id", "kind", "segment"), ["kind", "segment"])
    return wide.unpivot("id", [c for c in wide.columns if c != "id"], "feature", "value")


def _codes(c: str) -> str:
    return f"""SELECT '{c}' AS feature, level, CAST(ROW_NUMBER() OVER (ORDER BY level) - 1 AS INT) AS code, COUNT(*) OVER () AS cardinality
  FROM (SELECT DISTINCT {c} AS level FROM cohort)"""


@query("category_codes", f"WITH {x.COHORT_CTE} " + " UNION ALL ".join(map(_codes, ("nation", "segment", "kind", "code_raw"))))
def category_codes(spark, sf):
    return f.category_codes(x.cohort(spark, sf), ["nation", "segment", "kind", "code_raw"])


@query("encode_categories", f"""WITH {x.CLEAN_CTE}, codes AS (SELECT nation, DENSE_RANK() OVER (ORDER BY nation) - 1 AS a FROM (SELECT DISTINCT nation FROM clean))
SELECT id, CAST(a AS INT) AS nation, CASE WHEN code IS NULL THEN -1 ELSE CAST(code AS INT) END AS code FROM clean JOIN codes USING (nation)""")
def encode_categories(spark, sf):
    return f.encode_categories(x.clean(spark, sf).select("id", "nation", "code"), ["nation", "code"])


_MATRIX = ("nation", "segment", "kind", "code", "spend_cents", "avg_cents", "bal", "sparse_num")


def _dummies(c: str) -> str:
    return f"""SELECT '{c}=' || CASE WHEN n * 1.0 / (SELECT COUNT(*) FROM clean) >= 0.005 THEN level ELSE 'Other' END AS feature,
  CAST(SUM(n) AS DOUBLE) AS sum_sq FROM (SELECT COALESCE(CAST({c} AS VARCHAR), 'Missing') AS level, COUNT(*) AS n FROM clean GROUP BY 1) GROUP BY 1"""


@query("design_matrix", f"""WITH {x.CLEAN_CTE} SELECT UNNEST(['spend_cents', 'avg_cents', 'bal']) AS feature,
  CAST((SELECT COUNT(*) FROM clean) AS DOUBLE) AS sum_sq UNION ALL """ + " UNION ALL ".join(map(_dummies, ("nation", "segment", "kind", "code"))))
def design_matrix(spark, sf):
    matrix, design = f.design_matrix(x.clean(spark, sf).select("id", *_MATRIX), "id", numeric_keywords=_KEYWORDS)
    norms = vector_to_array(Summarizer.normL2(F.col("features")))
    names = F.array(*[F.lit(n) for n in design.features])
    return matrix.agg(norms.alias("v")).select(F.inline(F.arrays_zip(names.alias("feature"), F.transform(
        "v", lambda y: F.round(y * y, 6)).alias("sum_sq"))))


def _number(c: str) -> str:
    return f"""SELECT id, '{c}' AS feature, (v - AVG(v) OVER ()) / COALESCE(NULLIF(stddev_pop(v) OVER (), 0), 1) AS value
  FROM (SELECT id, COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM clean)) AS v FROM clean)"""


def _indicator(c: str) -> str:
    return f"""SELECT id, '{c}=' || CASE WHEN COUNT(*) OVER (PARTITION BY level) * 1.0 / COUNT(*) OVER () >= 0.005 THEN level ELSE 'Other' END AS feature,
  1.0 AS value FROM (SELECT id, COALESCE(CAST({c} AS VARCHAR), 'Missing') AS level FROM clean)"""


@query("design_cells", f"""WITH {x.CLEAN_CTE}, cells AS ({" UNION ALL ".join([*map(_number, ("spend_cents", "avg_cents", "bal")), *map(_indicator, ("nation", "segment", "kind", "code"))])})
SELECT id, feature, {r6('value', 4)} AS value FROM cells WHERE ROUND(value, 4) <> 0""")
def design_cells(spark, sf):
    """Every cell of the design matrix that is not 0, by row."""
    matrix, design = f.design_matrix(x.clean(spark, sf).select("id", *_MATRIX), "id", numeric_keywords=_KEYWORDS)
    names = F.array(*[F.lit(n) for n in design.features])
    cells = matrix.select("id", F.inline(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value"))))
    return rounded(cells, "value", digits=4).filter("value <> 0")


_WIDE = ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


def _place(i: int, c: str) -> str:
    before = " + ".join(["0", *[f"(SELECT COUNT(DISTINCT {b}) FROM orders)" for b in _WIDE[:i]]])
    return f"""SELECT o_orderkey, {1 + i} AS k, 1 + {before} + DENSE_RANK() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS place, 1.0 AS value FROM orders"""


@query("sparse_indicators", f"""WITH cells AS (SELECT o_orderkey, 0 AS k, 0 AS place, o_totalprice AS value FROM orders UNION ALL {" UNION ALL ".join(_place(i, c) for i, c in enumerate(_WIDE))})
SELECT o_orderkey, CAST(k AS INT) AS k, CAST(place AS INT) AS place, CAST(value AS DOUBLE) AS value,
  CAST(1 + {" + ".join(f"(SELECT COUNT(DISTINCT {c}) FROM orders)" for c in _WIDE)} AS INT) AS width FROM cells""")
def sparse_indicators(spark, sf):
    """The parts of one sparse vector per order: its price, then an indicator of customer, status, priority and date."""
    orders = x.table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    words = s.level_dictionary(orders, _WIDE).persist()
    rows = s.sparse_indicators(orders, _WIDE, words, ["o_orderkey"], [F.col("o_totalprice")])
    cells = rows.select("o_orderkey", s.vector_parts("features").alias("p"))
    return cells.select("o_orderkey", F.posexplode(F.arrays_zip("p.indices", "p.values")).alias("k", "c"), "p.size").select(
        "o_orderkey", "k", F.col("c.indices").alias("place"), F.col("c.values").alias("value"), F.col("size").alias("width"))


_FEATURES = """SELECT DISTINCT 'nation=' || nation AS feature FROM {cohort} UNION SELECT DISTINCT 'kind=' || kind FROM {cohort}
UNION SELECT DISTINCT 'code_raw__missing=' || CASE WHEN code_raw = 'N/A' THEN '1' ELSE '0' END FROM {cohort}
UNION SELECT CASE WHEN n_orders >= 0 THEN 'n_orders' ELSE 'spend_cents' END FROM {cohort}
UNION SELECT CASE WHEN urgent > 2 THEN 'urgent' ELSE 'max_price' END FROM {cohort}"""


@query("assign_groups", f"""WITH {x.COHORT_CTE}, features AS ({_FEATURES.format(cohort='cohort')}),
named AS (SELECT feature, REPLACE(REGEXP_REPLACE(feature, '=.*$', ''), '__missing', '') AS base FROM features)
SELECT feature, CASE WHEN base IN ('nation', 'region') THEN 'place' WHEN base IN ('code_raw') THEN 'coding'
  WHEN starts_with(base, 'n_') OR base LIKE '%orders%' THEN 'volume' WHEN base LIKE '%price%' OR base LIKE 'spend%' THEN 'money'
  ELSE 'rest' END AS feature_group, CASE WHEN feature LIKE '%=%' THEN 1 ELSE 0 END AS is_binary FROM named""")
def assign_groups(spark, sf):
    names = spark.sql(_FEATURES, cohort=x.cohort(spark, sf))
    return f.assign_groups(names, {"place": ["nation", "region"], "coding": ["code_raw"]},
                           [("volume", ["n_%", "%orders%"]), ("money", ["%price%", "spend%"])], "rest")


_SHOWN = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} = FLOOR({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {0}) END"
_FLAG_NAMES = {d: d.capitalize() for d in DOMAINS}


@query("text_card", f"""WITH {x.CLEAN_CTE}, {FLAGS_SQL}, shown AS (SELECT *, {_SHOWN.format('bal')} AS b, {_SHOWN.format('sparse_num')} AS s,
  {_SHOWN.format('code')} AS c, CAST(n_orders AS VARCHAR) AS o, concat_ws(', ', {', '.join(f"CASE WHEN {d} = 1 THEN '{n}' END" for d, n in _FLAG_NAMES.items())}) AS imp FROM levels)
SELECT id, concat_ws(' ', 'Sample ' || id || '.', 'Place: nation=' || nation || '; region=' || region || '.',
    CASE WHEN b IS NOT NULL OR s IS NOT NULL THEN 'Money: ' || concat_ws('; ', 'bal=' || b, 'sparse=' || s) || '.' END,
    CASE WHEN c IS NOT NULL THEN 'Coding: code=' || c || '.' END, 'Total: ' || total || '.') AS text_card,
  concat_ws(' ', 'Sample ' || id || '.', 'orders ' || o || '.', 'balance ' || b || '.') AS flat_card,
  'Customer ' || id || ' of ' || region || ' has ' || COALESCE(o, 'nan') || ' orders and code ' || COALESCE(c, 'nan') || '.' AS sentence,
  CASE WHEN imp = '' THEN 'None' ELSE imp END AS impaired FROM shown""")
def text_card(spark, sf):
    df = flagged(spark, sf)
    show = lambda c: readable_value(F.col(c), missing=None)
    lead = F.concat(F.lit("Sample "), F.col("id").cast("string"))
    out = f.text_card(df, F.concat(lead, F.lit(".")), {
        "Place": [("nation", F.col("nation")), ("region", F.col("region"))],
        "Money": [("bal", show("bal")), ("sparse", show("sparse_num"))], "Coding": [("code", show("code"))]},
        F.concat(F.lit("Total: "), F.col("total").cast("string"), F.lit(".")))
    out = f.flat_card(out, lead, [(F.col("n_orders"), F.concat(F.lit("orders "), show("n_orders"))),
                                  (F.col("bal"), F.concat(F.lit("balance "), show("bal")))], out="flat_card")
    out = f.sentence_card(out, "Customer {id} of {region} has {orders} orders and code {code}.",
                          {"id": F.col("id"), "region": F.col("region"), "orders": show("n_orders"), "code": show("code")}, "sentence")
    return out.select("id", "text_card", "flat_card", "sentence",
                      f.listed_or_none([(n, F.col(d)) for d, n in _FLAG_NAMES.items()]).alias("impaired"))


@query("tfidf_terms", f"""WITH tokens AS (SELECT doc_id AS id, regexp_extract_all(LOWER(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
terms AS (SELECT id, UNNEST(t) AS term FROM tokens UNION ALL
  SELECT id, UNNEST([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM tokens),
counts AS (SELECT id, term, COUNT(*) AS tf FROM terms GROUP BY id, term),
vocabulary AS (SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM counts GROUP BY term HAVING COUNT(*) >= 5
  ORDER BY total DESC, term LIMIT 4096),
raw AS (SELECT id, term, tf, df, LN((1.0 + (SELECT COUNT(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM counts JOIN vocabulary USING (term))
SELECT id, term, tf, df, {r6('idf')} AS idf, {r6('tf * idf / SQRT(SUM(tf * idf * tf * idf) OVER (PARTITION BY id))')} AS weight FROM raw""")
def tfidf_terms(spark, sf):
    return rounded(f.tfidf_terms(x.table(spark, sf, "documents"), "doc_id", "text", 5, 4096), "idf", "weight")


def _text_scores(spark, sf):
    vectors = f.tfidf_vectors(x.table(spark, sf, "documents"), "doc_id", "text", min_df=5, max_features=4096).persist()
    return e.svd_embed(vectors, 128, out="embedding").select("id", vector_to_array("embedding").alias("v"))


@query("tfidf_embed")
def tfidf_embed(spark, sf):
    return _text_scores(spark, sf).select("id", F.size("v").alias("dims"), F.round(norm(F.col("v")), 4).alias("length"))


@query("tfidf_axes", """SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(0 AS DOUBLE) AS product, (SELECT COUNT(*) FROM documents) AS n
FROM range(12) p(a), range(12) q(b) WHERE a < b""")
def tfidf_axes(spark, sf):
    """The scores on different axes are uncorrelated about zero: their products vanish beside the lengths of both."""
    v = _text_scores(spark, sf)
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    at = lambda i: F.col("v")[i]
    sums = v.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(at(a) * at(b)) / F.sqrt(F.sum(at(a) * at(a)) * F.sum(at(b) * at(b)))).alias(f"p{a}_{b}") for a, b in pairs])
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(F.abs(f"p{a}_{b}"), 6) + 0.0).alias("product")) for a, b in pairs]))
    return sums.select("n", cells)


def embedded(spark, sf):
    """(id, label, outcome, features) of the vectors."""
    return as_vector(x.vectors(spark, sf), "embedding").select("id", "label", "outcome", "features")


@query("pca_embed")
def pca_embed(spark, sf):
    out = e.pca_embed(embedded(spark, sf), 2).withColumn("v", vector_to_array("embedding"))
    return out.select("id", "label", *[F.round(F.col("v")[i], 6).alias(f"pc{i + 1}") for i in range(2)])


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    return e.kmeans_labels(embedded(spark, sf), 6).select("id", "cluster")


@query("kmeans_nearest", f"WITH {x.VECTORS_CTE} SELECT id, CAST(6 AS BIGINT) AS clusters, TRUE AS nearest FROM vectors")
def kmeans_nearest(spark, sf):
    """Whether the mean of a row's own cluster is its nearest one, up to the movement at which the fit stops."""
    rows = embedded(spark, sf).select("id", vector_to_array("features").alias("v"), "features")
    labelled = e.kmeans_labels(rows, 6).select("id", "v", "cluster")
    means = labelled.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.avg("x").alias("m"))
    long = labelled.select("id", "cluster", F.posexplode("v").alias("at", "x")).join(means.select("at", F.col("cluster").alias("other"), "m"), "at")
    d = long.groupBy("id", "cluster", "other").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("d"))
    own = F.max(F.when(F.col("cluster") == F.col("other"), F.col("d")))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("clusters"), (own <= F.min("d") + 0.001).alias("nearest"))


@query("gmm_labels")
def gmm_labels(spark, sf):
    return e.gmm_labels(embedded(spark, sf), 4).select("id", "cluster")


@query("reorder_labels", f"""WITH {x.VECTORS_CTE}, means AS (SELECT label2, ROW_NUMBER() OVER (ORDER BY AVG(outcome), label2) - 1 AS r FROM vectors GROUP BY label2)
SELECT id, CAST(r AS INT) AS label2 FROM vectors JOIN means USING (label2)""")
def reorder_labels(spark, sf):
    return e.reorder_labels(x.vectors(spark, sf).select("id", "label2", "outcome"), "label2", "outcome").select("id", "label2")


@query("fuse_embeddings", f"""WITH {x.SECOND_VIEW_CTE}, fused AS (SELECT id, [(p[1] + p[2]) / 2.0 FOR p IN list_zip(own, view)] AS m,
  len(list_concat(own, view)) AS both_dims FROM second_view)
SELECT id, CAST(UNNEST(range(len(m))) AS INT) AS pos, UNNEST([{r6('v')} FOR v IN m]) AS mean,
  UNNEST([{r6('v / SQRT(list_inner_product(m, m))')} FOR v IN m]) AS unit_mean, CAST(both_dims AS INT) AS both_dims FROM fused""")
def fuse_embeddings(spark, sf):
    own, view = x.vectors(spark, sf).select("id", "embedding"), x.second_view(spark, sf)
    rows = e.fuse_embeddings(own, view, "id", "embedding", "view", ["mean", "unit_mean", "concat"])
    return rounded(rows.select("id", F.posexplode(F.arrays_zip("mean", "unit_mean")).alias("pos", "p"), F.size("concat").alias("both_dims"))
                   .select("id", "pos", "p.mean", "p.unit_mean", "both_dims"), "mean", "unit_mean")


@query("fuse_concat_pca")
def fuse_concat_pca(spark, sf):
    own, view = x.vectors(spark, sf).select("id", "embedding"), x.second_view(spark, sf)
    out = e.fuse_concat_pca(own, view, "id", "embedding", "view", 8)
    return out.select("id", F.round(norm(vector_to_array("fused")), 6).alias("length"))
