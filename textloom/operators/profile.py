"""Profiles of text columns: one aggregation each, partial before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom.functions import text as X
from textloom.functions.constants import CATEGORY_NAMES, PROMPT_NAMES, RESPONSE_NAMES, RISK_KEYWORDS
from textloom.plans.storage import materialize


def _five(c: str, name: str) -> list[Column]:
    """min, max, mean, exact median and exact interpolated p95. (Lengths have few distinct values, which is what the exact
    percentile keeps in memory.)"""
    return [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{name}_median"), F.percentile(c, F.lit(0.95)).alias(f"{name}_p95")]


def row_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: count, missing, distinct (null and empty are one value), and five figures each of characters and words."""
    base = df.select(F.col(column).alias("raw"), X.filled(column).alias("t"), X.n_chars(column).alias("chars"), X.n_words(column).alias("words"))
    plain = base.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("raw").isNull()).alias("n_missing"), *_five("chars", "chars"), *_five("words", "words"))
    # texts are counted by their digest, so the distinct count moves 32 bytes a text
    distinct = base.agg(F.count_distinct(F.sha2("t", 256)).alias("n_unique"))
    return plain.crossJoin(distinct)  # one row each


def text_quality(df: DataFrame, column: str) -> DataFrame:
    """One row: mean over rows of the share of Bangla, Latin and digit characters, rows with and without Bangla, and rows
    that are valid UTF-8 (or not)."""
    raw = F.col(column)
    base = df.select(X.class_ratio(column, X.BANGLA).alias("bangla"), X.class_ratio(column, X.LATIN).alias("latin"), X.class_ratio(column, X.DIGIT).alias("digit"), X.class_count(column, X.BANGLA).alias("n_bangla"), F.coalesce(F.is_valid_utf8(raw), F.lit(True)).alias("valid"))
    return base.agg(
        F.avg("bangla").alias("mean_bangla_ratio"), F.avg("latin").alias("mean_latin_ratio"), F.avg("digit").alias("mean_digit_ratio"),
        F.count_if(F.col("n_bangla") > 0).alias("rows_with_bangla"), F.count_if(F.col("n_bangla") == 0).alias("rows_without_bangla"),
        F.count_if("valid").alias("utf8_rows"), F.count_if(~F.col("valid")).alias("non_utf8_rows"),
    )


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n_missing`` of each column, from one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns))).alias("x")).select("x.*")


def schema_report(df: DataFrame) -> DataFrame:
    """``position, column_name, data_type, n_rows`` of each column."""
    fields = F.array(*(F.struct(F.lit(i).cast("long").alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for i, f in enumerate(df.schema.fields)))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(fields).alias("x"), "n_rows").select("x.*", "n_rows")


def category_columns(df: DataFrame, names: Sequence[str] = tuple(CATEGORY_NAMES)) -> list[str]:
    """Columns whose name holds one of the names."""
    return [c for c in df.columns if any(n in c.lower() for n in names)]


def infer_roles(df: DataFrame, other: DataFrame | None = None) -> tuple[str, str]:
    """The prompt and the response column: by name, in declared order; if either is missing, the only text column for
    both, or else the shortest on average for the prompt and the longest for the response. ``other`` (a second table of
    the corpus) takes no part in the choice but must have the prompt column."""
    by_name = lambda names: next((c for c in df.columns if any(n in c.lower() for n in names)), None)
    prompt, response = by_name(PROMPT_NAMES), by_name(RESPONSE_NAMES)
    if prompt is None or response is None:
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if len(text) == 1:
            prompt = response = text[0]
        elif text:
            means = df.agg(*(F.avg(X.n_chars(c)).alias(c) for c in text)).first()
            ranked = sorted(text, key=lambda c: means[c] or 0.0)  # stable: ties by declared order
            prompt = prompt or ranked[0]
            response = response or (ranked[-1] if len(ranked) > 1 else None)
    if prompt is None:
        raise ValueError("no prompt column")
    if other is not None and prompt not in other.columns:
        raise ValueError(f"the other table has no column {prompt}")
    return prompt, response or prompt


def schema_roles(df: DataFrame) -> DataFrame:
    prompt, response = infer_roles(df)
    roles = [("prompt", prompt), ("response", response), *(("category", c) for c in category_columns(df))]
    return df.sparkSession.createDataFrame(roles, "role string, column_name string")


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """``value, n``, null counted as empty."""
    return df.groupBy(X.filled(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def repeated_values(df: DataFrame, column: str, limit: int = 25) -> DataFrame:
    """The most frequent values (ties in order of the value): ``value, n``."""
    return value_frequencies(df, column).orderBy(F.desc("n"), "value").limit(limit)


def value_diversity(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct values, their ratio (0 for no rows), values seen at least twice and at least five times."""
    return value_frequencies(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum("n")), F.lit(0.0)).alias("unique_ratio"),
        F.count_if(F.col("n") >= 2).alias("seen_twice"), F.count_if(F.col("n") >= 5).alias("seen_five_times"),
    )


def top_tokens(df: DataFrame, column: str, key: str, limit: int = 50) -> DataFrame:
    """``token, n`` of the most frequent script tokens; ties in order of first sight (by key, then place).

    All tokens are counted with their least key only, which partial hash aggregates can do; places are looked up in the
    texts of those few that may be among the first.
    """
    words = df.select(F.col(key).alias("k"), F.explode(X.script_tokens(column)).alias("token"))
    counts = materialize(words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")))
    shown = counts.orderBy(F.desc("n"), F.asc_nulls_last("k")).limit(limit).collect()  # as many rows as are asked for
    if len(shown) < limit:
        may_be = counts
    else:
        n, k = shown[-1]["n"], shown[-1]["k"]
        tied = F.lit(True) if k is None else F.col("k") <= F.lit(k)
        may_be = counts.where((F.col("n") > n) | (F.col("n") == n) & tied)
    # ties may be many: how the two sides meet is left to the optimizer, which knows the size of a written table
    rows = df.select(F.col(key).alias("_k"), F.col(column).alias("_t")).join(may_be, F.col("_k").eqNullSafe(F.col("k")))
    placed = rows.withColumn("_s", X.script_tokens("_t")).groupBy("token", "n", "k").agg(F.min(F.nullif(F.array_position("_s", F.col("token")), F.lit(0))).alias("p"))
    return placed.orderBy(F.desc("n"), F.asc_nulls_last("k"), "p").limit(limit).select("token", "n")


def vocabulary_size(df: DataFrame, column: str, cap: int = 10_000) -> DataFrame:
    """One row: distinct script tokens, and the same cut off at the length of a truncated list."""
    n = df.select(F.explode(X.script_tokens(column)).alias("token")).agg(F.count_distinct("token").alias("n_tokens"))
    return n.select("n_tokens", F.least("n_tokens", F.lit(cap)).cast("long").alias("n_tokens_capped"))


def keyword_hits(df: DataFrame, column: str, keywords: Sequence[str] = tuple(RISK_KEYWORDS)) -> DataFrame:
    """``keyword, n``: distinct raw texts that hold the keyword, whatever the case; keywords without a hit are left out."""
    distinct = df.select(X.filled(column).alias("t")).distinct()
    # the texts stay where they are: the hits of a text are an array, as long as the keyword list at most
    hits = F.filter(F.array(*(F.when(X.contains_ignoring_case("t", k), F.lit(k)) for k in dict.fromkeys(keywords))), lambda k: k.isNotNull())
    return distinct.select(F.explode(hits).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, column: str, quantile: float) -> DataFrame:
    """One row ``value``: entry ``floor(q * n)``, counted from 0, of the sorted values. Values are counted first, so what
    is put in order is their distinct values, never the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("value", F.sum("n").over(W.orderBy("value")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("total"))
    return upto.where(F.col("upto") > F.floor(F.lit(quantile) * F.col("total"))).agg(F.min("value").alias("value"))


def length_report(df: DataFrame, column: str, limit: int) -> DataFrame:
    """One row on token counts: mean, median, nearest-rank p95, interpolated p95, max, and whether p95 is over the limit."""
    plain = df.agg(F.count(column).alias("n_rows"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.95)).alias("p95_interpolated"), F.max(column).alias("max"))
    return plain.crossJoin(nearest_rank(df, column, 0.95).withColumnRenamed("value", "p95")).withColumn("over_limit", F.col("p95") > limit)
