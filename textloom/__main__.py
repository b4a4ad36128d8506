"""``python -m textloom audit|split|retrieve|prepare``: the batch jobs from CSV files to reports, splits and examples."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.constants import MAX_SEQUENCE, MODES, VALIDATION_RATIO
from textloom.functions import text as X
from textloom.operators import split as S
from textloom.operators import training as T
from textloom.operators.profile import infer_roles
from textloom.plans.audit import audit_report, render_markdown
from textloom.plans.retrieval import benchmark
from textloom.plans.storage import materialize
from textloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str, ledger: bool = True) -> argparse.ArgumentParser:
        j = jobs.add_parser(name)
        for x in paths:
            j.add_argument(f"--{x}", required=True)
        if ledger:
            j.add_argument("--ledger", default=None)
        return j

    a = job("audit", "train", "test", "out", ledger=False)
    a.add_argument("--config", default=None, help="a flat YAML file in which the roles are recorded")
    a.add_argument("--sample-submission", default=None)
    s = job("split", "train", "out")
    s.add_argument("--ratio", type=float, default=VALIDATION_RATIO)
    s.add_argument("--write", action="store_true")
    s.add_argument("--document", default=None, help="with --write: the split as one JSON document as well")
    r = job("retrieve", "train", "split", "out")
    r.add_argument("--eval-limit", type=int, default=0)
    r.add_argument("--model", default=None, help="module:factory of a model that encodes; adds the dense method")
    r.add_argument("--most-encoded", type=int, default=0, help="evenly spaced corpus rows that the dense method searches; 0: all")
    t = job("prepare", "train", "split", "out")
    t.add_argument("--mode", choices=list(MODES), default="smoke")
    t.add_argument("--max-seq-len", type=int, default=MAX_SEQUENCE)
    t.add_argument("--experiment-id", default=None, help="names the folder below --out; the mode and the time if not given")
    t.add_argument("--resume", action="store_true", help="name the latest checkpoint of the experiment's folder")
    t.add_argument("--model", default=None, help="module:factory of a model that tokenizes and generates")
    t.add_argument("--skip-samples", action="store_true", help="no answers of the model for review")
    return p


def audit(a: argparse.Namespace, spark: SparkSession) -> dict:
    status = writers.Status(f"{a.out}/data_audit_status.txt")
    status.mark("starting")
    train, test = materialize(readers.read_pairs(spark, a.train)), materialize(readers.read_pairs(spark, a.test, response=False))
    status.mark(f"loaded_csv train={train.count()} test={test.count()}")
    prompt, response = infer_roles(train, test)
    if a.config:
        writers.write_config(a.config, prompt, response)
        status.mark(f"config_updated prompt={prompt} response={response}")
    sample = a.sample_submission is not None and readers.path_exists(spark, a.sample_submission)
    files = {"train_filename": os.path.basename(a.train), "test_filename": os.path.basename(a.test), "sample_submission_present": sample}
    report = audit_report(train, test, "id", prompt, response, files=files, mark=lambda stage: status.mark(f"build_report:{stage}"))
    if a.config:
        report["config_update"] = readers.read_config(a.config)
    writers.write_json_document(report, f"{a.out}/data_audit.json")
    writers.write_text(render_markdown(report), f"{a.out}/data_audit.md")
    status.mark("finished")
    return report["duplicates"] | {"near_duplicate_pairs": len(report["duplicates"]["near_duplicate_pairs"])}


def split(a: argparse.Namespace, spark: SparkSession) -> dict:
    train = materialize(readers.read_pairs(spark, a.train))
    assigned = materialize(S.split_assign(train, "input", "id", a.ratio))
    if a.write:
        writers.write_split(assigned, a.out)
        if a.document:
            edges = S.length_edges(S.prompt_facts(train, "input", "id")).first().asDict()
            dataset = {"train_csv_sha256": digest(spark, a.train), "train_row_count": train.count()}
            writers.write_json_document(writers.split_document(assigned, writers.split_metadata(assigned, edges, dataset)), a.document)
        if a.ledger:
            writers.append_ledger(writers.split_ledger_row(assigned), a.ledger)
    return {"summary": [r.asDict() for r in S.split_summary(assigned).collect()]} | S.leakage_check(assigned).first().asDict()


def digest(spark: SparkSession, path: str) -> str:
    return readers.file_digests(spark, path).first()["sha256"]


def side(train: DataFrame, split: str, name: str) -> DataFrame:
    assigned = readers.read_split(train.sparkSession, split)
    return S.members(train, assigned.where(assigned.side == name).select("id"), "id")


def retrieve(a: argparse.Namespace, spark: SparkSession) -> dict:
    train = materialize(readers.read_pairs(spark, a.train))
    encode = readers.NamedModel(a.model).encode if a.model else None
    queries, corpus = S.first_rows(side(train, a.split, "validation"), "id", a.eval_limit), side(train, a.split, "train")
    results = materialize(benchmark(queries, corpus, "input", "output", "id", encode=encode, most_encoded=a.most_encoded))
    writers.write_metrics(results, f"{a.out}/retrieval_results.json", f"{a.out}/retrieval_results.md")
    if a.ledger:
        writers.append_ledger(writers.ledger_rows(results, "split_v1"), a.ledger)
    return {r.method_name: r.token_f1 for r in results.collect()}


def prepare(a: argparse.Namespace, spark: SparkSession) -> dict:
    """``<out>/<experiment>/train`` and ``evaluation``: tokenized examples; ``smoke_samples.json``: a model's answers to five
    validation prompts. The ledger has a row for the start and one for the end."""
    began = time.monotonic()
    experiment = a.experiment_id or spark.range(1).select(X.run_id(a.mode)).first()[0]
    out = f"{a.out}/{experiment}"
    model = readers.NamedModel(a.model) if a.model else None
    tokenize = model.tokenize if model else None
    train = materialize(readers.read_pairs(spark, a.train))
    rows, validation = materialize(T.training_rows(side(train, a.split, "train"), "id", a.mode)), materialize(side(train, a.split, "validation"))
    said: dict = {"experiment_id": experiment, "fertility": {r["part"]: r.asDict() for r in T.fertility(rows, "input", "output", "id", 100, a.max_seq_len, tokenize).collect()}}
    if said["fertility"]["total"]["over_limit"]:
        said["warning"] = f"p95 of all tokens ({said['fertility']['total']['p95']}) is over --max-seq-len ({a.max_seq_len})"
    parameters = T.parameter_report(model.parameters()) if model and model.parameters() else None
    dataset = f"train_rows={train.count()};sha256={digest(spark, a.train)}"

    def log(minutes: float | None = None) -> None:
        if a.ledger:
            facts = {"model_name": a.model or "", "tokenizer": a.model or "words"}
            writers.append_ledger(writers.training_ledger_row(spark, experiment, a.mode, rows.count(), dataset, a.max_seq_len, parameters, minutes, "preparation", **facts), a.ledger)

    log()
    if a.resume:
        folder = readers.list_folder(spark, out) if readers.path_exists(spark, out) else None
        found = readers.latest_checkpoint(folder).first() if folder is not None else None
        said["resume_from"] = found["path"] if found else None
    for name, part in (("train", rows), ("evaluation", T.evaluation_rows(validation, "id"))):
        T.tokenized(T.formatted(part, "input", "output", "id"), "text", "id", a.max_seq_len, encode=tokenize).write.mode("overwrite").parquet(f"{out}/{name}")
    said |= {"examples": spark.read.parquet(f"{out}/train").count(), "evaluation_examples": spark.read.parquet(f"{out}/evaluation").count()}
    if model and not a.skip_samples:
        writers.write_review_samples(T.generated(S.fixed_sample(validation, "id", 5), "input", "output", "id", model.generate), f"{out}/smoke_samples.json")
    log((time.monotonic() - began) / 60)
    return said


JOBS = {"audit": audit, "split": split, "retrieve": retrieve, "prepare": prepare}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    said = {"job": a.job} | JOBS[a.job](a, spark or SparkSession.builder.appName("textloom").getOrCreate())
    print(json.dumps(said, ensure_ascii=False, indent=2, default=str))
    return said


if __name__ == "__main__":
    main()
