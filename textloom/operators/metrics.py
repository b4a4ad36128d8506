"""Scores of predicted against target texts, and the record of a retrieval method."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from textloom.functions import text as X
from textloom.operators.split import evenly_spaced
from textloom.plans.storage import ship

#: Texts on which the costly score is computed at most, evenly spaced.
SCORED = 1000


def _prf(overlap, predicted, target, name: str):
    """Precision, recall and F1 of an overlap; two empty texts agree, one empty text has nothing right."""
    p = F.when((predicted == 0) & (target == 0), 1.0).otherwise(F.coalesce(F.try_divide(overlap, predicted), F.lit(0.0)))
    r = F.when((predicted == 0) & (target == 0), 1.0).otherwise(F.coalesce(F.try_divide(overlap, target), F.lit(0.0)))
    return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias(f"{name}_f1")]


def token_scores(pairs: DataFrame, key: str = "query_id", prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``key, token_precision, token_recall, token_f1`` by the multiset overlap of normalized words."""
    base = pairs.select(F.col(key), X.tokens(prediction).alias("p"), X.tokens(target).alias("t"))
    words = base.select(key, F.explode("p").alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(base.select(key, F.explode("t").alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = words.groupBy(key, "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("o"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  pairs of empty texts have no words
    return base.select(key).join(both, key, "left").select(key, *_prf(zero("o"), zero("a"), zero("b"), "token"))


def distinct_keys(df: DataFrame, key: str) -> bool:
    """Whether no key is null or repeated. Only the keys are read."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: one big-integer step for each entry of b (bit-parallel)."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        u = row & places.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def rouge_scores(pairs: DataFrame, key: str = "query_id", prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``key, rouge_l_precision, rouge_l_recall, rouge_l_f1``."""
    ship(pairs.sparkSession)
    base = pairs.select(F.col(key), X.tokens(prediction).alias("p"), X.tokens(target).alias("t"))
    return base.withColumn("o", lcs("p", "t")).select(key, *_prf(F.col("o"), F.size("p"), F.size("t"), "rouge_l"))


@F.pandas_udf(LongType())
def shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)], dtype="int64")


def pair_scores(pairs: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """What token_scores() and rouge_scores() give for distinct keys, without them: row by row, so that nothing is shuffled."""
    ship(pairs.sparkSession)
    base = pairs.select(X.tokens(prediction).alias("p"), X.tokens(target).alias("t"))
    both = base.select(F.size("p").alias("a"), F.size("t").alias("b"), shared_words("p", "t").alias("o"), lcs("p", "t").alias("l"))
    return both.select(*_prf(F.col("o"), F.col("a"), F.col("b"), "token"), *_prf(F.col("l"), F.col("a"), F.col("b"), "rouge_l"))


def reuse_rate(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: distinct responses, and the share of queries that the most frequent tenth of them answers (one at least).
    Responses are ordered by how often they occur, and only the distinct frequencies meet in one place."""
    often = predictions.groupBy(prediction).agg(F.count(F.lit(1)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    w = W.orderBy(F.desc("c"))
    upto = often.select("c", "m", F.sum("m").over(w).alias("upto"), F.sum("m").over(W.partitionBy()).alias("k"), F.sum(F.col("c") * F.col("m")).over(W.partitionBy()).alias("n"))
    top = F.greatest(F.lit(1), F.floor(F.lit(0.10) * F.col("k")))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), top - (F.col("upto") - F.col("m"))))
    return upto.agg(F.coalesce(F.max("k"), F.lit(0)).alias("unique_responses_retrieved"), F.coalesce(F.try_divide(F.sum(taken * F.col("c")), F.max("n")), F.lit(0.0)).alias("top_10_response_reuse_rate"))


Scorer = Callable[[list[str], list[str]], list[float]]


def model_score(pairs: DataFrame, scorer: Scorer, key: str = "query_id", most: int = SCORED) -> DataFrame:
    """One row ``bert_score_f1``: the mean of a model's score over at most ``most`` evenly spaced pairs."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer(b.column(0).to_pylist(), b.column(1).to_pylist()), pa.float64())], ["s"])

    rows = evenly_spaced(pairs.select(key, "prediction", "target"), key, most)
    return rows.select(X.filled("prediction"), X.filled("target")).mapInArrow(run, "s double").agg(F.avg("s").alias("bert_score_f1"))


def evaluate(pairs: DataFrame, method: str, seconds: float | None = None, key: str = "query_id", fallback: str = "is_fallback", scorer: Scorer | None = None, distinct: bool = False) -> DataFrame:
    """One row, the record of a method on ``key, prediction, target, is_fallback``. Without a ``scorer`` the model-based
    score is stood in for by the mean ROUGE-L F1, which ``bert_score_is_proxy`` says. ``distinct``: distinct_keys() holds, so
    that the pairs are scored without a shuffle."""
    lengths = pairs.agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.avg(F.col(fallback).cast("int")), F.lit(0.0)).alias("fallback_rate"),
        F.avg(X.n_chars("prediction")).alias("retrieved_length_mean_chars"), F.percentile(X.n_chars("prediction"), F.lit(0.5)).alias("retrieved_length_median_chars"),
        F.avg(X.n_chars("target")).alias("actual_length_mean_chars"), F.percentile(X.n_chars("target"), F.lit(0.5)).alias("actual_length_median_chars"),
    )
    scores = pair_scores(pairs) if distinct else token_scores(pairs, key).join(rouge_scores(pairs, key), key)
    means = scores.agg(*(F.avg(f"{m}_{x}").alias(f"{m}_{x}") for m in ("token", "rouge_l") for x in ("f1", "precision", "recall")))
    scored = means.withColumn("bert_score_f1", F.col("rouge_l_f1")) if scorer is None else means.crossJoin(model_score(pairs, scorer, key))
    one = scored.crossJoin(lengths).crossJoin(reuse_rate(pairs))  # one row each
    mismatch = F.abs(F.col("retrieved_length_mean_chars") - F.col("actual_length_mean_chars")) / F.greatest("actual_length_mean_chars", F.lit(1.0)) > 0.50
    elapsed = F.lit(seconds).cast("double")
    return one.select(
        F.lit(method).alias("method_name"), "token_f1", "token_precision", "token_recall", "rouge_l_f1", "rouge_l_precision", "rouge_l_recall",
        "bert_score_f1", F.lit(scorer is None).alias("bert_score_is_proxy"), elapsed.alias("total_time_seconds"), F.try_divide(elapsed * 1000, F.col("n_queries")).alias("ms_per_query"),
        "fallback_rate", "unique_responses_retrieved", "top_10_response_reuse_rate", "retrieved_length_mean_chars", "retrieved_length_median_chars",
        "actual_length_mean_chars", "actual_length_median_chars", mismatch.alias("length_mismatch_flag"),
    )
