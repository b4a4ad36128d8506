"""Sinks: reports, splits, metrics, review samples and the experiment ledger."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.constants import ADAPTER, LEDGER_COLUMNS, MAX_SEQUENCE, MODES, SEED
from textloom.operators.split import LABELS, leakage_check, split_summary
from textloom.sources.readers import ledger_columns, path_exists, path_size, read_config


def write_json_document(value: Any, path: str) -> None:
    """Pretty UTF-8 JSON without ASCII escapes: for reports of a bounded size."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


class Status:
    """A marker file that says which stage is running."""

    def __init__(self, path: str):
        self.path = path

    def mark(self, message: str) -> None:
        write_text(message + "\n", self.path)


def write_config(path: str, prompt: str, response: str) -> bool:
    """Record the roles in a flat configuration; what else it says stays. True if the file changed."""
    before = read_config(path) if Path(path).exists() else {}
    after = before | {"prompt_column": prompt, "response_column": response, "submission_prediction_column": response}
    after.setdefault("id_column", "TBD")
    after.setdefault("sample_submission_filename", "TBD")
    if after == before:
        return False
    write_text("".join(f"{k}: {v}\n" for k, v in after.items()), path)
    return True


def write_split(assigned: DataFrame, path: str) -> None:
    """The assignment as Parquet, a folder for each side: ids of any number, never gathered."""
    assigned.write.mode("overwrite").partitionBy("side").parquet(path)


def split_metadata(assigned: DataFrame, edges: dict[str, float], dataset: dict[str, Any]) -> dict[str, Any]:
    """What a split document says beside the ids: its data, ratios, length edges and labels of both sides."""
    sides = {r["side"]: r.asDict() for r in split_summary(assigned).collect()}
    of = lambda side, c: sides[side][c] if side in sides else 0
    both = ("train", "validation")
    return {
        "dataset_version": dataset,
        "split_ratio": {s: of(s, "ratio") for s in both},
        "length_bucket_edges": {c: edges[c] for c in ("short_medium", "medium_long")},
        "stratification_summary": {"medical_category": None} | {s: {x: of(s, x) for x in LABELS} for s in both},
        "near_duplicate_detection": {"method": "equal_normalized_prompts", "no_component_on_both_sides": leakage_check(assigned).first()["no_leakage"]},
    }


def split_document(assigned: DataFrame, metadata: dict[str, Any]) -> dict[str, Any]:
    """The assignment as one document, for splits small enough to be one."""
    side = lambda s: [r[0] for r in assigned.where(F.col("side") == s).select("id").orderBy("id").collect()]
    train, validation = side("train"), side("validation")
    return {"seed": SEED, "split_version": "split_v1", "train_row_ids": train, "validation_row_ids": validation, "row_counts": {"train": len(train), "validation": len(validation)}} | metadata


def ledger_schema_rows(df: DataFrame, columns: list[str] = LEDGER_COLUMNS) -> DataFrame:
    """All ledger columns in order as text: missing ones empty, unknown ones left out."""
    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns))


def split_ledger_row(assigned: DataFrame) -> DataFrame:
    counts = assigned.agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "validation").alias("v"))
    version = X.key_values([("train_rows", "t", "%d"), ("validation_rows", "v", "%d")])
    return ledger_schema_rows(counts.select(F.lit(f"split_v1_seed{SEED}").alias("experiment_id"), version.alias("dataset_version"), F.lit("split_v1").alias("split_version"), F.lit("split_creation").alias("model_name"), F.lit("approved fixed split for all future experiments").alias("decision_next_step")))


def ledger_rows(results: DataFrame, split_version: str) -> DataFrame:
    """Ledger rows of metrics records."""
    scores = X.key_values([("token_f1", "token_f1", "%.4f"), ("rouge_l_f1", "rouge_l_f1", "%.4f"), ("bert_score_f1", "bert_score_f1", "%.4f"), ("ms_per_query", F.coalesce("ms_per_query", F.lit(0.0)), "%.2f"), ("fallback_rate", "fallback_rate", "%.4f")])
    return ledger_schema_rows(
        results.select(
            F.concat(F.lit("baseline_"), X.slug("method_name")).alias("experiment_id"), F.lit(f"split_version={split_version}").alias("dataset_version"), F.lit(split_version).alias("split_version"),
            F.concat(F.lit("retrieval_baseline_"), X.slug("method_name", hyphens=False)).alias("model_name"), F.lit("v1").alias("model_revision"), F.lit("0").alias("exact_total_parameters"), F.lit("0").alias("trainable_parameters"),
            F.lit("bengali_whitespace").alias("tokenizer"), F.lit("retrieval_baseline_non_trainable").alias("training_config"), F.lit("top1_nearest_neighbor").alias("generation_settings"), scores.alias("validation_metrics"),
            F.lit("retrieval_from_train_corpus").alias("manual_safety_findings"), F.lit("baseline score logged for model comparison").alias("decision_next_step"),
        )
    )


def training_ledger_row(spark: SparkSession, experiment: str, mode: str, n_rows: int, dataset: str, most: int = MAX_SEQUENCE, parameters: dict[str, Any] | None = None, minutes: float | None = None, job: str = "training", **facts: str) -> DataFrame:
    """The ledger row of a job that starts or, given its ``minutes``, is complete. ``facts`` are further columns (model,
    tokenizer, split); sizes are blank without a model's ``parameters``."""
    c, a = MODES[mode], ADAPTER
    config = (
        f"mode={mode};r={a['r']};alpha={a['alpha']};dropout={a['dropout']};targets={'|'.join(a['targets'])};max_seq_len={most};"
        f"batch={c['per_device_train_batch_size']}x{c['gradient_accumulation_steps']};max_steps={c['max_steps']};epochs={c['num_train_epochs']};train_rows={n_rows}"
    )
    row = {
        "experiment_id": experiment if minutes is None else f"{experiment}-COMPLETE", "dataset_version": dataset, "split_version": "split_v1", "training_config": config,
        "decision_next_step": f"{job} started" if minutes is None else f"{job} finished in {minutes:.1f}min; review samples before next step",
    }
    if parameters:
        row |= {"exact_total_parameters": f"{parameters['total'] / 1e9:.3f}B", "trainable_parameters": f"{parameters['trainable'] / 1e6:.1f}M"}
    row |= facts
    return ledger_schema_rows(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)))


def append_ledger(rows: DataFrame, path: str, strict: bool = False) -> None:
    """Append to a ledger folder of CSV files, each with the header. Unknown columns are an error if asked, else left out;
    a new ledger, or one of a few bytes, starts with the fixed columns."""
    new = not path_exists(rows.sparkSession, path) or path_size(rows.sparkSession, path) < 10
    columns = LEDGER_COLUMNS if new else ledger_columns(rows.sparkSession, path)
    if strict and (unknown := [c for c in rows.columns if c not in columns]):
        raise ValueError(f"unknown ledger columns: {unknown}")
    ledger_schema_rows(rows, columns).coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)


def metrics_markdown(results: DataFrame) -> str:
    """A table of the records, one line a method."""
    head = ["Method", "Token F1", "ROUGE-L", "BERTScore", "Ms/Query", "Total Time (s)", "Fallback Rate", "Reuse Rate", "Ret. Mean Chars", "Act. Mean Chars", "Mismatch?"]
    number = lambda v, f: "-" if v is None else format(v, f)
    lines = ["# Retrieval Baseline Results", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    for r in results.collect():  # one row a method
        cells = [
            f"**{r.method_name}**", number(r.token_f1, ".4f"), number(r.rouge_l_f1, ".4f"), number(r.bert_score_f1, ".4f"), number(r.ms_per_query, ".2f") + "ms", number(r.total_time_seconds, ".2f") + "s",
            number(r.fallback_rate, ".2%"), number(r.top_10_response_reuse_rate, ".2%"), number(r.retrieved_length_mean_chars, ".1f"), number(r.actual_length_mean_chars, ".1f"), "⚠️ YES" if r.length_mismatch_flag else "✅ NO",
        ]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"


def write_metrics(results: DataFrame, json_path: str, markdown_path: str) -> None:
    write_json_document([r.asDict() for r in results.collect()], json_path)
    write_text(metrics_markdown(results), markdown_path)


def write_review_samples(samples: DataFrame, path: str) -> None:
    """``patient_prompt, reference_response, generated_response`` and any further columns, as one array."""
    write_json_document([r.asDict() for r in samples.collect()], path)
