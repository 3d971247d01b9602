"""Row-wise Column expressions. All of them treat a missing value as SQL NULL."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(predicate: Column) -> Column:
    """A predicate on a missing value is false, never NULL."""
    return F.coalesce(predicate, F.lit(False))


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, map(is_true, predicates), F.lit(False))


def safe_numeric(col: Column | str) -> Column:
    """Coerce to double; text that is no number, and NaN, become NULL."""
    value = F.col(col) if isinstance(col, str) else col
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(col: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    # least / greatest skip NULL arguments, so NULL has to be kept by hand
    return F.when(col.isNotNull(), F.least(F.greatest(col, low), high))


def clip01(col: Column) -> Column:
    return clip(col, 0.0, 1.0)


def weighted_mean_available(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the inputs that are present; NULL when none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * F.lit(float(w)) for c, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts])
    return total / F.nullif(weight, F.lit(0.0))


#: every blank that text may carry around a value, not just the space
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a" \
         "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def code_key(col: Column) -> Column:
    """The text key of a code: trimmed, and ``1.0`` read as ``1``."""
    text = strip(col.cast("string"))
    return F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")


def fixed(number: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded by the exact binary value as ``printf`` does.

    ``format_string`` rounds the shortest decimal form instead, and shows 10.075 as 10.08.
    """
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def quote(name: str) -> str:
    """A column name made safe for ``F.col`` (names may hold dots or spaces)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("string", "varchar", "char")


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so that every operator sees one kind of missing."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select([
        F.when(~F.isnan(col(c)), col(c)).alias(c) if k in ("double", "float") else col(c)
        for c, k in kinds.items()
    ])


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name="feature", value="value",
         numeric=True) -> DataFrame:
    """Wide to long by one generator, NULLs kept out. ``numeric`` coerces with :func:`safe_numeric`."""
    cell = (lambda c: safe_numeric(col(c))) if numeric else (lambda c: col(c).cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias(name), cell(c).alias(value)) for c in values])
    return df.select(*[col(k) for k in keys], F.inline(pairs)).filter(F.col(value).isNotNull())
