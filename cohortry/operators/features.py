"""Feature preparation (E1-E9): typing, scaling, encoding, the design matrix and text features."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import col, melt, safe_numeric
from ..functions.ranks import medians, with_ranks
from ..functions.sizes import broadcast_if_small, few_rows, one_row
from ..presets import NON_FEATURES, NUMERIC_KEYWORDS
from .audit import column_facts
from .clean import codebook_apply, common_levels

#: levels one column may be spread over as indicator columns
MAX_LEVELS = 1_000
#: texts of a partition from which on they are dealt to all cores
DEAL = 4096
WORD = r"[\p{L}\p{N}_]{2,}"


def feature_kind(name: str, facts: Mapping, numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS) -> str:
    """The rule of the wide matrix: numeric by content and name, else categorical when few levels."""
    mostly = facts["numeric_share"] > 0.9
    if mostly and (facts["distinct_numbers"] > 10 or any(k in name for k in numeric_keywords)):
        return "numeric"
    if facts["distinct"] <= 20:
        return "categorical"
    return "numeric" if facts["numeric_share"] > 0.5 else "categorical"


def curated_kind(name: str, facts: Mapping, always_numeric: Sequence[str] = ()) -> str:
    """The rule of the curated matrix."""
    if name in always_numeric:
        return "numeric"
    return "numeric" if facts["numeric_share"] > 0.9 and facts["distinct_numbers"] > 10 else "categorical"


def split_feature_types(df: DataFrame, columns: Sequence[str] | None = None, curated: bool = False,
                        numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS,
                        always_numeric: Sequence[str] = ()) -> dict[str, str]:
    facts = column_facts(df, columns)
    if curated:
        return {c: curated_kind(c, f, always_numeric) for c, f in facts.items()}
    return {c: feature_kind(c, f, numeric_keywords) for c, f in facts.items()}


def feature_types_table(df: DataFrame, **options) -> DataFrame:
    kinds = split_feature_types(df, **options)
    return df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, divisor) per column; the divisor is the population deviation, or 1 when that is 0."""
    if not columns:
        return {}
    row = one_row(df.agg(*[x for i, c in enumerate(columns) for x in (
        F.avg(safe_numeric(col(c))).alias(f"m{i}"), F.stddev_pop(safe_numeric(col(c))).alias(f"s{i}"))]))
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def zscore_expr(value: Column, mean: float, divisor: float) -> Column:
    return (safe_numeric(value) - F.lit(mean)) / F.lit(divisor)


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = moments(df, columns)
    return df.select([zscore_expr(col(c), *known[c]).alias(c) if c in known else col(c) for c in df.columns])


def levels_of(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column; refuses columns that have too many to become indicators."""
    if not columns:
        return {}
    long = melt(df, [], columns, "feature", "level", numeric=False).distinct()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in few_rows(long, max_levels * len(columns), "levels of categorical columns"):
        out[r["feature"]].append(r["level"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every level of every column as a 0/1 column ``col=level``; none is dropped."""
    levels = levels_of(df, columns) if levels is None else levels
    dummies = [F.coalesce(col(c).cast("string") == v, F.lit(False)).cast("int").alias(f"{c}={v}")
               for c in columns for v in levels[c]]
    return df.select(*[col(c) for c in df.columns if c not in columns], *dummies)


def category_codes(df: DataFrame, columns: Sequence[str], **rank_options) -> DataFrame:
    """(feature, level, code, cardinality): codes count the sorted levels from 0, however many there are."""
    levels = melt(df, [], columns, "feature", "level", numeric=False).distinct().withColumn("n", F.lit(1).cast("long"))
    sizes = levels.groupBy("feature").agg(F.count(F.lit(1)).alias("cardinality"))
    ranked = with_ranks(levels, "level", ["feature"], before="__before", **rank_options).join(sizes, "feature")
    return ranked.select("feature", "level", F.col("__before").cast("int").alias("code"), "cardinality")


def encode_categories(df: DataFrame, columns: Sequence[str], unknown: int = -1) -> DataFrame:
    """Replace each listed column by its category code; unseen and missing levels get ``unknown``."""
    codes, out = category_codes(df, columns), df
    for c in columns:
        side = codes.filter(F.col("feature") == c).select(F.col("level").alias("__level"), F.col("code").alias("__code"))
        out = (out.join(side, col(c).cast("string") == F.col("__level"), "left")
               .withColumn(c, F.coalesce("__code", F.lit(unknown))).drop("__level", "__code"))
    return out.select([col(c) for c in df.columns])


# --- design matrix -------------------------------------------------------------

@dataclass
class Design:
    """A fitted design matrix: everything needed to turn rows into feature vectors."""
    numeric: list[str]
    categorical: list[str]
    fill: dict[str, float | None]
    scale: dict[str, tuple[float, float]]
    kept: dict[str, list[str]]
    levels: dict[str, list[str]]
    codebook: DataFrame | None = None
    missing: str = "Missing"
    other: str = "Other"
    features: list[str] = field(init=False)

    def __post_init__(self):
        self.features = [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in self.levels[c]]]

    def parts(self) -> list[Column]:
        out = [zscore_expr(F.coalesce(safe_numeric(col(c)), F.lit(self.fill[c]).cast("double")), *self.scale[c])
               for c in self.numeric]
        for c in self.categorical:
            text = F.coalesce(col(c).cast("string"), F.lit(self.missing))
            for v in self.levels[c]:
                hit = ~text.isin([k for k in self.kept[c] if k != v]) if v == self.other else text == v
                out.append(hit.cast("double"))
        return [F.coalesce(x, F.lit(0.0)) for x in out]

    def transform(self, df: DataFrame, keep: Sequence[str], out: str = "features") -> DataFrame:
        """Rows to (keep..., vector) in one projection."""
        src = df
        if self.codebook is not None and self.categorical:
            src = codebook_apply(df, self.codebook, self.categorical)
        return src.select(*[col(c) for c in keep], array_to_vector(F.array(*self.parts())).alias(out))

    def metadata(self, spark, exact=None, patterns=(), default="other") -> DataFrame:
        """(feature, index, feature_group, is_binary)"""
        base = spark.createDataFrame([(f, i) for i, f in enumerate(self.features)], "feature string, index int")
        return assign_groups(base, exact or {}, patterns, default).orderBy("index")


def fit_design(df: DataFrame, exclude: Sequence[str] = (), codebook: DataFrame | None = None,
               curated: bool = False, min_share: float = 0.005, max_missing: float = 0.95,
               derived_prefix: str | None = "IC_", always_numeric: Sequence[str] = (),
               numeric_keywords: Sequence[str] = NUMERIC_KEYWORDS, indicators: bool = False,
               indicator_share: float = 0.05) -> tuple[Design, DataFrame]:
    """Learn the design matrix: sparse columns out, types, medians, deviations, levels.

    Returns the design and the frame it applies to (with missing indicators added
    when ``indicators``). Four jobs, whatever the number of columns.
    """
    src = df
    out = {*NON_FEATURES, *exclude}
    columns = [c for c in df.columns if c in always_numeric
               or not (c in out or (derived_prefix and c.startswith(derived_prefix)))]
    facts = column_facts(df, columns)
    n_rows = max((f["rows"] for f in facts.values()), default=0)
    missing = {c: (f["rows"] - f["present"]) / n_rows if n_rows else 0.0 for c, f in facts.items()}
    columns = [c for c in columns if c in always_numeric or missing[c] < max_missing]
    kind = (lambda c: curated_kind(c, facts[c], always_numeric)) if curated else \
        (lambda c: feature_kind(c, facts[c], numeric_keywords))
    numeric = [c for c in columns if kind(c) == "numeric"]
    categorical = [c for c in columns if c not in numeric]
    if indicators:
        flagged = [c for c in numeric if missing[c] >= indicator_share]
        src = df.select("*", *[col(c).isNull().cast("int").alias(f"{c}__missing") for c in flagged])
        categorical += [f"{c}__missing" for c in flagged]
    fill = medians(df, numeric, {c: facts[c]["numbers"] for c in numeric}) if numeric else {}
    read = codebook_apply(src, codebook, categorical) if codebook is not None and categorical else src
    common = common_levels(read, categorical, min_share, n_rows=n_rows)
    kept = {c: sorted(v) for c, v in common.items()}
    rare = {c for c, v in common.items() if sum(v.values()) < n_rows}
    levels = {c: sorted({*v, "Other"}) if c in rare else v for c, v in kept.items()}
    scale = {c: _filled_moments(facts[c], fill[c], n_rows) for c in numeric}
    return Design(numeric, categorical, fill, scale, kept, levels, codebook), src


def _filled_moments(facts: Mapping, fill: float | None, n_rows: int) -> tuple[float, float]:
    """Mean and population deviation of a column once its gaps hold ``fill``."""
    n, gaps = facts["numbers"], n_rows - facts["numbers"]
    if not n:
        return 0.0, 1.0
    mean = (n * facts["mean"] + gaps * fill) / n_rows
    squares = facts["squares"] + n * gaps / n_rows * (facts["mean"] - fill) ** 2
    return mean, (squares / n_rows) ** 0.5 or 1.0


def design_matrix(df: DataFrame, id_col: str, keep: Sequence[str] = (), **options) -> tuple[DataFrame, Design]:
    """(id, keep..., features) and the fitted design."""
    design, src = fit_design(df, exclude=[id_col, *keep, *options.pop("exclude", ())], **options)
    return design.transform(src, [id_col, *keep]), design


def _like(name: Column, pattern: str) -> Column:
    """``%`` stands for any text at an end; every other character, also ``_``, is meant literally."""
    core = pattern.strip("%")
    if pattern.startswith("%") and pattern.endswith("%"):
        return name.contains(core)
    if pattern.endswith("%"):
        return name.startswith(core)
    return name.endswith(core) if pattern.startswith("%") else name == core


def assign_groups(features: DataFrame, exact: Mapping[str, Sequence[str]], patterns=(), default: str = "other",
                  feature: str = "feature") -> DataFrame:
    """Add ``feature_group`` (exact names first, then patterns with ``%`` at the ends, then the default) and ``is_binary``."""
    base = F.regexp_replace(F.regexp_replace(col(feature), "=.*$", ""), "__missing", "")
    group = None
    for name, members in exact.items():
        hit = base.isin(*members)
        group = F.when(hit, F.lit(name)) if group is None else group.when(hit, F.lit(name))
    for name, likes in patterns:
        hit = F.lit(False)
        for like in likes:
            hit = hit | _like(base, like)
        group = F.when(hit, F.lit(name)) if group is None else group.when(hit, F.lit(name))
    group = F.lit(default) if group is None else group.otherwise(F.lit(default))
    return features.select("*", group.alias("feature_group"), col(feature).contains("=").cast("int").alias("is_binary"))


# --- text ------------------------------------------------------------------------

def text_card(df: DataFrame, lead: Column, sections: Mapping[str, Sequence[tuple[str, Column]]],
              tail: Column | None = None, out: str = "text_card") -> DataFrame:
    """Add one text per row: ``lead``, then ``Section: a=x; b=y.`` of the fields that are present, then ``tail``."""
    parts = [lead]
    for section, fields in sections.items():
        items = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v)) for n, v in fields]))
        parts.append(F.when(F.size(items) > 0, F.concat(F.lit(f"{section}: "), F.array_join(items, "; "), F.lit("."))))
    if tail is not None:
        parts.append(tail)
    return df.select("*", F.concat_ws(" ", *parts).alias(out))


def flat_card(df: DataFrame, lead: Column, fields: Sequence[tuple[Column, Column]], end: str = ".",
              out: str = "text_card") -> DataFrame:
    """Add one text per row of ``lead`` and the sentences whose value is present: (presence, sentence)."""
    said = [F.when(value.isNotNull(), F.concat(sentence, F.lit(end))) for value, sentence in fields]
    return df.select("*", F.concat_ws(" ", F.concat(lead, F.lit(end)), *said).alias(out))


def listed_or_none(flags: Sequence[tuple[str, Column]], none: str = "None") -> Column:
    """Names of the flags that are 1, comma separated."""
    names = F.array_compact(F.array(*[F.when(f == 1, F.lit(n)) for n, f in flags]))
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(none))


def sentence_card(df: DataFrame, template: str, values: Mapping[str, Column], out: str = "text_card",
                  missing: str = "nan") -> DataFrame:
    """Fill ``{name}`` marks of a template with column values; a missing value shows as ``missing``."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(F.coalesce(values[piece].cast("string"), F.lit(missing)))
        elif piece:
            pieces.append(F.lit(piece))
    return df.select("*", F.concat(*pieces).alias(out))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term), one row per word and per pair of neighbouring words."""
    split = texts.select(col(id_col).alias("id"), words(col(text_col)).alias("w"))
    # zip and explode stay in generated code, where lambda functions over arrays would not
    after = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    pairs = split.select("id", F.inline(F.arrays_zip(F.col("w").alias("a"), after.alias("b"))))
    both = F.array(F.col("a"), F.concat(F.col("a"), F.lit(" "), F.col("b")))
    return pairs.select("id", F.explode(both).alias("term")).filter(F.col("term").isNotNull())


def tfidf_terms(df: DataFrame, id_col: str, text_col: str, min_df: int = 5, max_features: int = 4096,
                n_docs: int | None = None) -> DataFrame:
    """(id, term, tf, df, idf, weight): word 1-2-grams, smoothed idf, weights of length one per text.

    The vocabulary is a top-k and hence small enough to broadcast, however often a single
    word occurs. Texts are shuffled once, by id and before they are split, so counting
    within a text and its norm need no further shuffle, and only words of the vocabulary
    are counted.
    """
    docs = df.count() if n_docs is None else n_docs
    # a fixed number of parts: text grows when it is split, so parts must not be merged by their size before
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(col(id_col).alias("id"), col(text_col).alias("text")).repartition(parts, "id")
    terms = terms_of(texts, "id", "text")
    vocabulary = (terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
                  .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
                  .filter(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features)
                  .select("term", "df", (F.log((1.0 + docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    vocabulary = broadcast_if_small(vocabulary, max_features)
    counts = terms.join(vocabulary, "term").groupBy("id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("df").alias("df"), F.first("idf").alias("idf"))
    raw = counts.withColumn("__w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", "idf", (F.col("__w") / length).alias("weight"))


def dealt(docs: DataFrame) -> DataFrame:
    """Texts as they lie, or, where one partition holds most of many, as of a file that is read as one, shuffled to all cores.
    Only rows are counted for it, no text is read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    held = one_row(docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    if held["most"] <= max(DEAL, 2 * held["total"] / cores):
        return docs
    # a fixed number of parts: text grows when it is split
    return docs.repartition(max(cores, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *docs.columns)


def tfidf_vectors(df: DataFrame, id_col: str, text_col: str, min_df: int = 5, max_features: int = 4096,
                  out: str = "features") -> DataFrame:
    """(id, sparse unit vector) of word 1-2-grams with Spark ML's own transformers."""
    docs = dealt(df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("__text")))
    tokens = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=WORD, gaps=False,
                            toLowercase=True).transform(docs)
    tokens = NGram(n=2, inputCol="__words", outputCol="__pairs").transform(tokens)
    tokens = tokens.select("id", F.concat("__words", "__pairs").alias("__terms"))
    counts = CountVectorizer(inputCol="__terms", outputCol="__tf", minDF=float(min_df),
                             vocabSize=max_features).fit(tokens).transform(tokens)
    # counted once, for the document frequencies and for the vectors
    counts = counts.select("id", "__tf").persist(StorageLevel.MEMORY_AND_DISK)
    # Spark's idf has no "+ 1", so the weights are applied with an explicit product
    idf = IDF(inputCol="__tf", outputCol="__tfidf").fit(counts).idf.toArray() + 1.0
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf").transform(counts)
    return Normalizer(inputCol="__tfidf", outputCol=out).transform(weighted).select("id", out)
