"""The audit of a train/test pair: one nested row, and a readable rendering of it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.constants import NEAR_DUPLICATE_THRESHOLD, RISK_KEYWORDS, SEED
from textloom.operators import duplicates as D
from textloom.operators import near_duplicates as N
from textloom.operators import profile as P

#: Entries of the lists in a report; counts are always of everything.
SHOWN_PAIRS, SHOWN_RESPONSES, SHOWN_TOKENS = 200, 25, 50


def audit_summary(train: DataFrame, test: DataFrame, prompt: str, response: str, key: str) -> DataFrame:
    """One row of counts: rows, duplicates on either side, overlap, duplicate and conflicting prompt groups."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    side = lambda df, name: D.duplicate_counts(df, prompt).select(*(F.col(c).alias(f"{name}_{c}") for c in ("full_row_duplicates", "prompt_duplicates")))
    groups = D.prompt_groups(train, prompt, response, key).agg(F.count(F.lit(1)).alias("duplicate_prompt_groups"), F.count_if(F.col("n_responses") > 1).alias("conflicting_prompt_groups"))
    parts = [count(train, "train_rows"), count(test, "test_rows"), side(train, "train"), side(test, "test"), count(D.overlap_rows(test, train, prompt), "exact_overlap_rows"), groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict(recursive=True)


def _rows(df: DataFrame, most: int) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def audit_report(train: DataFrame, test: DataFrame, key: str, prompt: str | None = None, response: str | None = None, threshold: float = NEAR_DUPLICATE_THRESHOLD, files: dict[str, Any] | None = None, mark: Callable[[str], None] = lambda stage: None) -> dict[str, Any]:
    """The whole audit as a nested document of bounded size. Every list in it is cut off, every count is complete.
    ``files`` names the sources; ``mark`` is told each stage that is done."""
    if prompt is None or response is None:
        prompt, response = P.infer_roles(train, test)
    files = {"train_filename": None, "test_filename": None, "sample_submission_present": False} | (files or {})
    texts = lambda df: [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    mark("text_columns_known")
    unique = D.keep_first(train.where(X.filled(prompt) != ""), prompt, key)
    unique_test = D.keep_first(test.where(X.filled(prompt) != ""), prompt, key)
    near = N.near_duplicates(test, train, prompt, key, threshold)
    n_near = near.count()
    mark(f"near_duplicates_done pairs={n_near}")
    summary = _one(audit_summary(train, test, prompt, response, key))
    mark("exact_duplicates_done")
    categories = P.category_columns(train)
    hits = lambda df, c: {r.keyword: r.n for r in P.keyword_hits(df, c, RISK_KEYWORDS).orderBy(F.desc("n"), "keyword").collect()}
    responses = _one(P.value_diversity(train, response)) | {"most_repeated": _rows(P.repeated_values(train, response, SHOWN_RESPONSES), SHOWN_RESPONSES)}
    mark("repeated_responses_counted")
    vocabulary = {c: _one(P.vocabulary_size(train, c)) | {"top_tokens": _rows(P.top_tokens(train, c, key, SHOWN_TOKENS), SHOWN_TOKENS)} for c in dict.fromkeys((prompt, response))}
    mark("vocabulary_built")
    report = {
        "source_files": {c: files[c] for c in ("train_filename", "test_filename")},
        "inferred_columns": {"prompt_column": prompt, "response_column": response},
        "schema": {n: {"columns": df.columns, "dtypes": dict(df.dtypes), "row_count": summary[f"{n}_rows"]} for n, df in (("train", train), ("test", test))},
        "missing_values": {n: {r.column_name: r.n_missing for r in P.missing_values(df).collect()} for n, df in (("train", train), ("test", test))},
        "duplicates": summary
        | {
            "exact_overlap_pairs": _rows(D.overlap_pairs(test, train, prompt, key).orderBy("test_id"), SHOWN_PAIRS),
            "conflicting_groups": _rows(D.conflicting_groups(train, prompt, response, key).orderBy(F.desc("n_rows"), "prompt"), SHOWN_PAIRS),
            "near_duplicate_threshold": threshold,
            "near_duplicate_pairs_found": n_near,
            "near_duplicate_pairs": _rows(near.orderBy("test_id"), SHOWN_PAIRS),
        }
        | N.near_duplicate_status(test, train, prompt),
        "statistics": {"train_prompt": _one(P.row_statistics(train, prompt)), "train_response": _one(P.row_statistics(train, response)), "test_prompt": _one(P.row_statistics(test, prompt))},
        "text_quality": {"train_prompt": _one(P.text_quality(train, prompt)), "train_response": _one(P.text_quality(train, response)), "test_prompt": _one(P.text_quality(test, prompt))},
        "vocabulary": vocabulary,
        "responses": responses,
        "medical_category": {"available_columns": categories, "note": "labels are there to stratify by" if categories else "no category-like column; lengths stand in for strata"},
        "split_recommendation": {"strategy": "stratified by length, grouped by normalized prompt", "seed": SEED, "grouping_key": "component of equal or near-duplicate prompts", "leakage_guard": "no component on both sides"},
        "retrieval_suitability": {"assessment": "the more often responses repeat, the better exact match and BM25 do; vectors help with paraphrases", "signals": {k: summary[k] for k in ("duplicate_prompt_groups", "conflicting_prompt_groups")} | {"near_duplicate_cross_split_pairs": n_near}},
        "safety_risk_surface": {"train_prompt_keyword_hits": hits(unique, prompt), "train_response_keyword_hits": hits(unique, response), "test_prompt_keyword_hits": hits(unique_test, prompt), "purpose": "shows what to review by hand; it is no diagnosis"},
        "notes": {"train_object_columns": texts(train), "test_object_columns": texts(test), "sample_submission_present": files["sample_submission_present"]},
    }
    mark("report_built")
    return report


def render_markdown(report: dict[str, Any]) -> str:
    """A section for each part of the report, a line for each figure; lists are given by their length."""

    def lines(value: Any, depth: int = 0):
        for k, v in value.items():
            name = "  " * depth + f"- {k.replace('_', ' ')}: "
            if isinstance(v, dict) and v:
                yield name.rstrip()
                yield from lines(v, depth + 1)
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                yield f"{name}`{len(v)}` shown"
            else:
                yield f"{name}`{', '.join(map(str, v)) if isinstance(v, list) else v}`"

    out = ["# Data audit"]
    for section, value in report.items():
        out += ["", f"## {section.replace('_', ' ').capitalize()}", *lines(value)]
    return "\n".join(out) + "\n"
