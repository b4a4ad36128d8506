"""The retrieval benchmark: several methods over one split, timed and scored."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import metrics as M
from textloom.operators import retrieval as R
from textloom.operators.split import evenly_spaced
from textloom.plans.storage import discard, materialize


def benchmark(queries: DataFrame, corpus: DataFrame, prompt: str, response: str, key: str, methods: tuple[str, ...] = ("Exact Match", "TF-IDF", "BM25", "Sentence Embedding"), encode: Callable[[list[str]], list[list[float]]] | None = None, most_encoded: int = 0) -> DataFrame:
    """One record a method. The time covers index building and retrieval up to the written predictions, not scoring. The
    dense method needs a model's ``encode`` and is left out without one; it searches the whole corpus, or as many evenly
    spaced rows of it as ``most_encoded`` says."""
    target = queries.select(F.col(key).alias("query_id"), X.filled(response).alias("target"))
    run = {
        "Exact Match": lambda: R.exact_match(queries, corpus, prompt, response, key),
        "TF-IDF": lambda: R.tfidf_top1(queries, corpus, prompt, response, key),
        "BM25": lambda: R.bm25_top1(queries, corpus, prompt, response, key),
        "Sentence Embedding": lambda: dense(queries, corpus, prompt, response, key, encode, most_encoded),
    }
    if encode is None:
        methods = tuple(m for m in methods if m != "Sentence Embedding")
    out = None
    for m in methods:
        began = time.monotonic()
        found = run[m]()
        fallback = F.col("is_fallback") if "is_fallback" in found.columns else F.lit(False)
        found = materialize(found.select("query_id", "prediction", fallback.alias("is_fallback")))
        seconds = time.monotonic() - began
        record = M.evaluate(found.join(target, "query_id"), m, seconds, distinct=M.distinct_keys(found, "query_id"))
        out = record if out is None else out.unionByName(record)
    return out


def dense(queries: DataFrame, corpus: DataFrame, prompt: str, response: str, key: str, encode: Callable[[list[str]], list[list[float]]], most_encoded: int = 0) -> DataFrame:
    """Each query's response by the nearest vector of a model. Both sides are encoded once and written, as blocks of the
    queries read the corpus repeatedly."""
    searched = evenly_spaced(corpus, key, most_encoded) if most_encoded else corpus
    vectors = [materialize(R.embedded(df, prompt, key, encode)) for df in (queries, searched)]
    found = materialize(R.dense_top1(*vectors, "id", "v"))
    discard(*vectors)
    return R.with_default(found, queries, searched, response, key)
