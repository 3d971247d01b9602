"""Data audit (C1-C9): every report is one or two wide aggregates, never a job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, is_text, melt, safe_numeric
from ..functions.ranks import exact_quantiles
from ..functions.sizes import one_row
from ..presets import DATE_WORD, MISSING_BINS, NUMERIC_KEYWORDS
from .clean import collapse_rare

#: sets are collected of columns whose sketched count is at most this; the rules ask about 20 levels and 10 numbers
_FEW = 200


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _as_date(c: str) -> Column:
    return F.try_to_timestamp(col(c).cast("string"))


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, date_word: str = DATE_WORD) -> dict[str, dict]:
    """Per column: rows, present and numeric cells, share of dates, mean and squared deviations of the
    numbers, and distinct counts that are exact when small.

    Distinct values are first sketched. Only columns whose sketch is small are then
    counted exactly with a set, so no task ever holds a large set.
    """
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    number = {c: safe_numeric(col(c).cast("string") if is_text(df, c) or not _is_number(df, c) else col(c)) for c in columns}
    dated = [c for c in columns if date_word in c]
    first = one_row(df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(columns) for x in (
        F.count(col(c)).alias(f"here{i}"), F.count(number[c]).alias(f"num{i}"),
        F.avg(number[c]).alias(f"m{i}"), F.var_pop(number[c]).alias(f"v{i}"),
        F.approx_count_distinct(col(c)).alias(f"d{i}"), F.approx_count_distinct(number[c]).alias(f"e{i}"))],
        *[F.count(_as_date(c)).alias(f"day{columns.index(c)}") for c in dated]))
    # texts and numbers are counted apart: many unequal texts may hold few numbers
    few = {f"d{i}": F.collect_set(col(c)) for i, c in enumerate(columns) if first[f"d{i}"] <= _FEW}
    few |= {f"e{i}": F.collect_set(number[c]) for i, c in enumerate(columns) if first[f"e{i}"] <= _FEW}
    sets = one_row(df.agg(*[F.size(v).alias(k) for k, v in few.items()])) if few else None
    n = first["n"] or 1
    facts = {}
    for i, c in enumerate(columns):
        exact = lambda k: sets[k] if k in few else first[k]
        facts[c] = {
            "rows": first["n"], "present": first[f"here{i}"], "numbers": first[f"num{i}"],
            "numeric_share": first[f"num{i}"] / n, "date_share": first[f"day{i}"] / n if c in dated else 0.0,
            "mean": first[f"m{i}"], "squares": (first[f"v{i}"] or 0.0) * first[f"num{i}"],
            "distinct": exact(f"d{i}"), "distinct_numbers": exact(f"e{i}"),
        }
    return facts


def _is_number(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")


def column_kind(name: str, facts: dict, date_word: str = DATE_WORD,
                numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS) -> str:
    if date_word in name and facts["date_share"] > 0.6:
        return "date"
    if facts["numeric_share"] > 0.9:
        coded = facts["distinct_numbers"] <= 10 and not any(k in name for k in numeric_keywords)
        return "categorical" if coded else "numeric"
    return "categorical" if facts["distinct"] <= 20 else "text"


def classify_columns(df: DataFrame, date_word: str = DATE_WORD,
                     numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS) -> DataFrame:
    """(column, kind): date, numeric, categorical or text."""
    facts = column_facts(df, date_word=date_word)
    return _local(df, [(c, column_kind(c, f, date_word, numeric_keywords)) for c, f in facts.items()],
                  "column string, kind string")


def profile_table(df: DataFrame, id_col: str, date_word: str = DATE_WORD,
                  numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS) -> DataFrame:
    """One row: rows, columns, distinct and missing ids, and the number of columns of each kind."""
    kinds = [column_kind(c, f, date_word, numeric_keywords) for c, f in column_facts(df, date_word=date_word).items()]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.count_distinct(col(id_col)).alias("id_distinct"),
        F.count_if(col(id_col).isNull()).alias("id_missing"),
        *[F.lit(kinds.count(k)).cast("long").alias(f"n_{k}") for k in ("date", "numeric", "categorical", "text")])


def missing_table(df: DataFrame) -> DataFrame:
    """(column, n_missing, n_rows, missing_rate) from one aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("__n") - F.col(f"c{i}")).alias("n_missing"),
                               F.col("__n").alias("n_rows")) for i, c in enumerate(df.columns)])
    return wide.select(F.inline(cells)).select(
        "*", F.coalesce(F.col("n_missing") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)).alias("missing_rate"))


def missing_rate(df: DataFrame, top: int = 30) -> DataFrame:
    """Columns with the largest share of NULL; ties by column name."""
    return missing_table(df).orderBy(F.desc("missing_rate"), "column").limit(top)


def missing_bins(df: DataFrame) -> DataFrame:
    """Number of columns per missing-rate bin; bins are right-closed and empty bins stay."""
    label = None
    for name, upper in MISSING_BINS:
        hit = F.col("missing_rate") <= upper
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    counted = missing_table(df).select(label.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_columns"))
    bins = _local(df, [(i, b) for i, (b, _) in enumerate(MISSING_BINS)], "bin_order int, bin string")
    return bins.join(counted, "bin", "left").select(
        "bin_order", "bin", F.coalesce("n_columns", F.lit(0)).cast("long").alias("n_columns"))


def outlier_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, p95, p99, max, n_above_p99); columns without a number are left out."""
    found = exact_quantiles(df, {c: (col(c), [0.95, 0.99]) for c in columns})
    used = [c for c in columns if found[c][0] is not None]
    if not used:
        return _local(df, [], "field string, p95 double, p99 double, max double, n_above_p99 long")
    wide = df.agg(*[x for i, c in enumerate(used) for x in (
        F.max(safe_numeric(col(c))).alias(f"m{i}"),
        F.count_if(safe_numeric(col(c)) > found[c][1]).alias(f"n{i}"))])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("field"), F.lit(found[c][0]).alias("p95"), F.lit(found[c][1]).alias("p99"),
        F.col(f"m{i}").alias("max"), F.col(f"n{i}").alias("n_above_p99")) for i, c in enumerate(used)])))


def range_check(df: DataFrame, columns: Sequence[str], scales: Sequence[float] = (10, 100)) -> DataFrame:
    """Guess each scale's range from its maximum and count the values outside it.

    The maximum lies inside the guessed range by construction, so only values under
    zero can be outside, and one pass is enough.
    """
    wide = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.min(safe_numeric(col(c))).alias(f"lo{i}"), F.max(safe_numeric(col(c))).alias(f"hi{i}"),
        F.count_if(safe_numeric(col(c)) < 0).alias(f"neg{i}"))])
    long = wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("field"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        F.col(f"neg{i}").alias("__neg")) for i, c in enumerate(columns)])))
    expected = None
    for top in sorted(scales):
        hit, text = F.col("max") <= top, F.lit(f"0-{top:g}")
        expected = F.when(hit, text) if expected is None else expected.when(hit, text)
    return (long.filter(F.col("max").isNotNull())
            .withColumn("expected_range", expected.otherwise("not_checked"))
            .withColumn("out_of_range", F.when(F.col("expected_range") != "not_checked", F.col("__neg")))
            .drop("__neg"))


def category_distribution(df: DataFrame, columns: Sequence[str], min_share: float = 0.005,
                          top: int = 12) -> DataFrame:
    """(field, level, n, share) after collapsing rare levels, the ``top`` most frequent per field."""
    levels = melt(collapse_rare(df, columns, min_share), [], columns, "field", "level", numeric=False)
    counted = levels.groupBy("field", "level").agg(F.count(F.lit(1)).alias("n"))
    # a handful of levels per field are left at this point
    per_field = W.partitionBy("field")
    return (counted.withColumn("share", F.col("n") / F.sum("n").over(per_field))
            .withColumn("__r", F.row_number().over(per_field.orderBy(F.desc("n"), "level")))
            .filter(F.col("__r") <= top).drop("__r"))


def topn_values(df: DataFrame, column: str, top: int = 15, missing: str = "Missing") -> DataFrame:
    """(value, n, share, missing_share) of the most frequent values; ties by value."""
    filled = df.select(F.coalesce(col(column).cast("string"), F.lit(missing)).alias("value"))
    row = one_row(filled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == missing).alias("m")))
    n = max(row["n"], 1)
    return (filled.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(top)
            .select("value", "n", (F.col("n") / F.lit(n)).alias("share"), F.lit(row["m"] / n).alias("missing_share")))


def event_month_histogram(df: DataFrame, start: str, years: str) -> DataFrame:
    """(month, n, share) of the estimated date start + years x 365.25 days."""
    micros = F.round(safe_numeric(col(years)) * 365.25 * 86_400 * 1_000_000).cast("long")
    begin = F.unix_micros(F.try_to_timestamp(col(start).cast("string")).cast("timestamp"))
    day = F.timestamp_micros(begin + micros)
    months = (df.select(F.date_format(day, "yyyy-MM").alias("month")).filter(F.col("month").isNotNull())
              .groupBy("month").agg(F.count(F.lit(1)).alias("n")))
    # months are few: the total is taken over them, not over the rows
    return months.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
