"""Cleaning and projections (B1-B12)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, code_key, col, fixed, is_text, melt, safe_numeric, strip
from ..functions.ranks import exact_quantiles, medians
from ..functions.sizes import few_rows, one_row
from ..presets import MISSING_TOKENS


def normalize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens (any case, blanks around them) and blank text become NULL; other text is untouched."""
    def cell(c: str) -> Column:
        if not is_text(df, c):
            return col(c)
        bare = F.upper(strip(col(c)))
        return F.when(~bare.isin(*tokens, ""), col(c)).alias(c)
    return df.select([cell(c) for c in df.columns])


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``safe_numeric`` on several columns in one projection."""
    chosen = set(columns)
    return df.select([safe_numeric(col(c)).alias(c) if c in chosen else col(c) for c in df.columns])


#: How code and label stand in a block of text. The first two eat the text from
#: left to right without looking back, so a long text costs one pass.
_PAIRS = {
    # label then code: F0 M1. Text that leads to no code is eaten as well, with an empty code.
    "label_code": r"([^0-9,]*+)(?:([0-9]+)|,|\z)",
    # code then label: 01"A",02"B"
    "code_label": r'([0-9]{1,3})\s*"?([^",]+)"?(?:,|\z)',
    # a range, then its code: <100 1, 100-200 2
    "range_code": r"([<>≥=\d\-]+)\s*(\d+)",
}
_CODE_FIRST = {"code_label"}


def _tidy(block: Column, form: str) -> Column:
    text = F.regexp_replace(block, "，", ",")
    if form == "label_code":
        text = F.regexp_replace(F.regexp_replace(text, "[、：]", " "), r"(?U)\s+", " ")
    return text


def codebook_extract(blocks: DataFrame, form: str, field: str = "field", block: str = "block",
                     order: str | None = None) -> DataFrame:
    """Blocks of text to (field, code, label); a code met twice keeps its last label.

    ``order`` ranks the blocks of one field when it has several.
    """
    first, second = (F.regexp_extract_all(F.col("__text"), F.lit(_PAIRS[form]), F.lit(i)) for i in (1, 2))
    code, label = (first, second) if form in _CODE_FIRST else (second, first)
    place = [col(order)] if order else []
    pairs = (blocks.select(col(field).alias("field"), *[p.alias("__order") for p in place],
                           _tidy(col(block), form).alias("__text"))
             .select("field", *(["__order"] if order else []),
                     F.posexplode(F.arrays_zip(code.alias("code"), label.alias("label"))).alias("__at", "p")))
    pairs = pairs.select("field", strip(F.col("p.code")).alias("code"), strip(F.col("p.label")).alias("label"),
                         F.struct(*(["__order"] if order else []), "__at").alias("__place"))
    return (pairs.filter((F.col("code") != "") & (F.col("label") != ""))
            .groupBy("field", "code").agg(F.max_by("label", "__place").alias("label")))


def field_blocks(df: DataFrame, id_col: str, text: str, fields: Sequence[str], mark: str = "：") -> DataFrame:
    """Cut running text at its field marks (a name and ``mark``) into (id, field, block).

    A field's block goes from its first mark to the next mark of another field, or to the end; marks of its own inside
    the block are text. A name that ends another one is met inside it as well. Fields that do not occur give no row, nor
    do missing texts; repeated ids stand for themselves.

    All marks are found in one pass: the longest name before a mark is read, and stands for the listed names it ends with.
    The cut stays inside the row, so nothing is shuffled.
    """
    names = list(dict.fromkeys(fields))
    if not names or not mark or any(not n or mark in n for n in names):
        raise ValueError("field names and the mark must not be empty, and names must not hold the mark")
    escaped = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    # what a field needs to know: the names it is met in, and how much of its own repeated mark a shorter name leaves to it
    rules = []
    for n in names:
        inner = max((m for m in names if m != n and n.endswith(m)), key=len, default=None)
        rules.append(F.struct(F.lit(n).alias("field"), F.array(*[F.lit(m) for m in names if m.endswith(n)]).alias("met"),
                              F.lit(None if inner is None else n[:-len(inner)]).cast("string").alias("front")))
    pattern = F.lit(f"({escaped}){re.escape(mark)}")
    found = df.filter(col(text).isNotNull()).select(
        col(id_col).alias("id"), F.regexp_extract_all(col(text), pattern, F.lit(1)).alias("m"),
        F.split(col(text), pattern, -1).alias("p")).filter(F.size("m") > 0)

    def block(rule: Column) -> Column:
        at = F.array_position(F.transform("m", lambda m: F.array_contains(rule["met"], m)), True).cast("int")
        later = F.slice("m", at + 1, F.size("m"))
        other = F.array_position(F.transform(later, lambda m: m != rule["field"]), True).cast("int")
        own = F.when(other == 0, F.size(later)).otherwise(other - 1)
        piece = lambda k: F.transform(F.slice("p", at + 1, k + 1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(rule["field"], F.lit(mark), p)))
        whole = F.array_join(piece(own), "")
        short = F.concat(F.element_at("p", at + 1), F.when(F.get(later, F.lit(0)) == rule["field"], rule["front"]).otherwise(F.lit("")))
        return F.when(at > 0, F.when(rule["front"].isNull(), whole).otherwise(short))

    cut = F.transform(F.array(*rules), lambda r: F.struct(r["field"].alias("field"), block(r).alias("block")))
    return found.select("id", F.inline(F.filter(cut, lambda x: x["block"].isNotNull())))


def targets_by_part(columns: Sequence[str], parts: Mapping[str, str]) -> dict[str, list[str]]:
    """For ``fan_out``: a field's codes go to every column whose name holds the field's part."""
    return {field: [c for c in columns if part in c] for field, part in parts.items()}


def fan_out(codebook: DataFrame, targets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give one field's codes to several columns; fields not named keep their own name."""
    known = F.create_map(*[x for f, cols in targets.items()
                           for x in (F.lit(f), F.array(*[F.lit(c) for c in cols]))])
    names = F.coalesce(F.element_at(known, F.col("field")), F.array("field"))
    return codebook.select(F.explode(names).alias("field"), "code", "label")


def codebook_apply(df: DataFrame, codebook: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace codes by labels; a code without a label stays as it is, as text.

    The first label in order stands for a code that is listed twice. Each column is joined with its part of
    the book, whatever its length; Spark broadcasts a short one and splits a hot code of a long one.
    """
    book = codebook.filter(F.col("field").isin(*columns)).groupBy("field", "code").agg(F.min("label").alias("label"))
    out = df
    for c in columns:
        side = book.filter(F.col("field") == c).select(F.col("code").alias("__code"), F.col("label").alias("__label"))
        out = (out.withColumn("__key", code_key(col(c)))
               .join(side, F.col("__key") == F.col("__code"), "left")
               .withColumn(c, F.coalesce("__label", col(c).cast("string")))
               .drop("__key", "__code", "__label"))
    return out.select([col(c) for c in df.columns])


def readable_value(value: Column, labels: Mapping[str, str] | None = None, flag: bool = False,
                   missing: str | None = "missing", yes: str = "yes", no: str = "no") -> Column:
    """Display text: the label if known, yes / no for flags, whole numbers without decimals, else two."""
    text = strip(value.cast("string"))
    number = safe_numeric(text)
    shown = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")) \
        .when(number.isNotNull(), fixed(number, 2)).otherwise(text)
    if flag:
        shown = F.when(number == 0, F.lit(no)).when(number == 1, F.lit(yes)).otherwise(shown)
    if labels:
        book = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        shown = F.coalesce(F.element_at(book, code_key(value)), shown)
    return F.when(value.isNull(), F.lit(missing)).otherwise(shown)


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each column to its own quantiles; a column without values passes through."""
    cuts = exact_quantiles(df, {c: (col(c), [low, high]) for c in columns})

    def cell(c: str) -> Column:
        if c not in cuts:
            return col(c)
        lo, hi = cuts[c]
        number = safe_numeric(col(c))
        return (number if lo is None else clip(number, lo, hi)).alias(c)
    return df.select([cell(c) for c in df.columns])


def impute_median(df: DataFrame, columns: Sequence[str], values: Mapping[str, float | None] | None = None) -> DataFrame:
    """Missing numbers become the column's median (or the given ``values``)."""
    fill = dict(values) if values is not None else medians(df, columns)

    def cell(c: str) -> Column:
        if c not in fill:
            return col(c)
        return F.coalesce(safe_numeric(col(c)), F.lit(fill[c]).cast("double")).alias(c)
    return df.select([cell(c) for c in df.columns])


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of NULL per column, all in one pass; an empty table has none missing."""
    row = one_row(df.agg(F.count(F.lit(1)).alias("__n"),
                         *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]))
    n = row["__n"]
    return {c: (n - row[f"c{i}"]) / n if n else 0.0 for i, c in enumerate(columns)}


def missing_indicator(df: DataFrame, columns: Sequence[str], min_share: float = 0.05,
                      suffix: str = "__missing") -> DataFrame:
    """Add a 0/1 column for every listed column whose share of NULL reaches ``min_share``."""
    shares = null_shares(df, columns)
    extra = [col(c).isNull().cast("int").alias(f"{c}{suffix}") for c in columns if shares[c] >= min_share]
    return df.select("*", *extra)


def level_counts(df: DataFrame, columns: Sequence[str], missing: str = "Missing") -> DataFrame:
    """(feature, level, n) of the text form of each column, NULL counted as its own level."""
    filled = df.select([F.coalesce(col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])
    return melt(filled, [], columns, "feature", "level", numeric=False).groupBy("feature", "level") \
        .agg(F.count(F.lit(1)).alias("n"))


def common_levels(df: DataFrame, columns: Sequence[str], min_share: float, missing: str = "Missing",
                  n_rows: int | None = None) -> dict[str, dict[str, int]]:
    """Levels that are not rare, with their counts. At most ``1 / min_share`` per column, so they fit on the driver."""
    if not columns:
        return {}
    total = df.count() if n_rows is None else n_rows
    # the exact comparison n / total >= share is kept: a product could round the other way
    common = level_counts(df, columns, missing).filter(F.col("n") / F.lit(float(max(total, 1))) >= min_share)
    rows = few_rows(common, int(len(columns) / min_share) + 1, "levels above the rarity limit")
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in rows:
        out[r["feature"]][r["level"]] = r["n"]
    return out


def kept_levels(df: DataFrame, columns: Sequence[str], min_share: float, missing: str = "Missing") -> dict[str, list[str]]:
    return {c: sorted(v) for c, v in common_levels(df, columns, min_share, missing).items()}


def collapse_rare(df: DataFrame, columns: Sequence[str], min_share: float = 0.005, missing: str = "Missing",
                  other: str = "Other", kept: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """NULL becomes ``missing``; a level below ``min_share`` becomes ``other``."""
    kept = kept_levels(df, columns, min_share, missing) if kept is None else kept

    def cell(c: str) -> Column:
        if c not in kept:
            return col(c)
        text = F.coalesce(col(c).cast("string"), F.lit(missing))
        return F.when(text.isin(*kept[c]), text).otherwise(F.lit(other)).alias(c) if kept[c] \
            else F.lit(other).alias(c)
    return df.select([cell(c) for c in df.columns])


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.95, named: Sequence[str] = (),
                        prefix: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Drop named columns, columns that start with ``prefix``, and those missing in ``max_missing`` or more."""
    left = [c for c in df.columns if c in keep or not (c in named or (prefix and c.startswith(prefix)))]
    shares = null_shares(df, [c for c in left if c not in keep])
    return df.select([col(c) for c in left if c in keep or shares[c] < max_missing])


def drop_by_pattern(df: DataFrame, patterns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Drop every column whose name contains one of the patterns. Needs no job."""
    return df.select([col(c) for c in df.columns if c in keep or not any(p in c for p in patterns)])


def rename_alias(df: DataFrame, alias: Mapping[str, str], first: Sequence[str] = ()) -> DataFrame:
    """Columns in report order under report names; names that are absent are skipped."""
    lead = [col(c) for c in first if c in df.columns]
    return df.select(*lead, *[col(c).alias(a) for c, a in alias.items() if c in df.columns and c not in first])
