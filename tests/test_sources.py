import csv
import hashlib
import json

import pytest

from textloom.__main__ import main
from textloom.functions.constants import LEDGER_COLUMNS
from textloom.plans.audit import audit_report, render_markdown
from textloom.sources import readers, writers


@pytest.fixture
def corpus(tmp_path):
    rows = [[i, f"prompt {'word ' * (i % 40)}{i % 90}", f'answer "{i}"\nline two'] for i in range(200)]
    rows[5][2] = "NA"
    for name, cut in (("train", 3), ("test", 2)):
        with (tmp_path / f"{name}.csv").open("w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["id", "input", "output"][:cut])
            w.writerows(r[:cut] for r in (rows if cut == 3 else rows[:10] + [[999, "new জ্বর", ""]]))
    return tmp_path


def test_csv(spark, corpus):
    df = readers.read_pairs(spark, str(corpus / "train.csv"))
    assert df.dtypes == [("id", "bigint"), ("input", "string"), ("output", "string")] and df.count() == 200
    row = df.where("id = 7").first()
    assert row.output == 'answer "7"\nline two' and df.where("id = 5").first().output is None
    assert dict(readers.read_csv(spark, str(corpus / "train.csv"), infer=True).dtypes)["id"] in ("int", "bigint")
    assert readers.read_pairs(spark, str(corpus / "train.csv"), "string").dtypes[0] == ("id", "string")


def test_files(spark, corpus):
    path = str(corpus / "train.csv")
    assert readers.find_file(spark, str(corpus), "train.csv").endswith("train.csv")
    assert readers.find_file(spark, str(corpus), "none.csv", optional=True) is None
    with pytest.raises(FileNotFoundError):
        readers.find_file(spark, str(corpus), "none.csv")
    digest = hashlib.sha256((corpus / "train.csv").read_bytes()).hexdigest()
    assert readers.file_digests(spark, path).first().sha256 == digest
    assert readers.digest_matches(spark, path, digest) and not readers.digest_matches(spark, path, "x")
    assert readers.path_exists(spark, path) and not readers.path_exists(spark, path + "x") and readers.path_size(spark, path + "x") == 0
    for n in (50, 100):
        (corpus / f"run/checkpoint-{n}").mkdir(parents=True)
    assert readers.latest_checkpoint(readers.list_folder(spark, str(corpus / "run"))).first().step == 100
    assert readers.from_columns(spark, {"text": ["a", "b"], "n": [1, 2]}).count() == 2


def test_split_document(spark, tmp_path):
    assigned = spark.createDataFrame([(1, "train"), (2, "train"), (3, "validation")], "id long, side string")
    doc = writers.split_document(assigned, {"split_ratio": {"train": 0.9, "validation": 0.1}})
    assert doc["row_counts"] == {"train": 2, "validation": 1} and doc["seed"] == 42
    doc["train_row_ids"].append(1)  # ids given twice count once
    writers.write_json_document(doc, str(tmp_path / "split.json"))
    assert sorted(map(tuple, readers.read_split(spark, str(tmp_path / "split.json")).collect())) == [("train", 1), ("train", 2), ("validation", 3)]


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    (tmp_path / "c.yaml").write_text("")
    assert readers.read_config(path) == {}
    assert writers.write_config(path, "input", "output") and not writers.write_config(path, "input", "output")
    assert readers.read_config(path)["submission_prediction_column"] == "output" and readers.read_config(path)["id_column"] == "TBD"


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("e1", "m", "extra")], "experiment_id string, model_name string, other string")
    with pytest.raises(ValueError, match="unknown"):
        writers.append_ledger(rows, path, strict=True)
    writers.append_ledger(rows, path)
    writers.append_ledger(rows, path)
    back = readers.read_csv(spark, path)
    assert back.columns == LEDGER_COLUMNS and back.count() == 2 and readers.ledger_columns(spark, path) == LEDGER_COLUMNS


def test_jobs(spark, corpus):
    c = str(corpus)
    said = main(["audit", "--train", f"{c}/train.csv", "--test", f"{c}/test.csv", "--out", f"{c}/out"], spark)
    report = json.loads((corpus / "out/data_audit.json").read_text())
    assert said["exact_overlap_rows"] == 10 and report["inferred_columns"] == {"prompt_column": "input", "response_column": "output"}
    assert report["missing_values"]["train"]["output"] == 1 and report["safety_risk_surface"]["test_prompt_keyword_hits"] == {"জ্বর": 1}
    assert (corpus / "out/data_audit.md").read_text().startswith("# Data audit") and "train rows" in (corpus / "out/data_audit.md").read_text().lower()
    said = main(["split", "--train", f"{c}/train.csv", "--out", f"{c}/split", "--ledger", f"{c}/ledger", "--write"], spark)
    assert said["no_leakage"]
    said = main(["retrieve", "--train", f"{c}/train.csv", "--split", f"{c}/split", "--out", f"{c}/out", "--ledger", f"{c}/ledger", "--eval-limit", "10"], spark)
    assert set(said) == {"job", "Exact Match", "TF-IDF", "BM25"}
    results = json.loads((corpus / "out/retrieval_results.json").read_text())
    assert results[0]["fallback_rate"] == 1.0 and all(r["ms_per_query"] > 0 for r in results)
    assert readers.read_csv(spark, f"{c}/ledger").count() == 4
    said = main(["prepare", "--train", f"{c}/train.csv", "--split", f"{c}/split", "--out", f"{c}/examples", "--mode", "full"], spark)
    assert said["examples"] == spark.read.parquet(f"{c}/split").where("side = 'train'").count()


class Toy(readers.ModelBackend):
    """A model of word counts: vectors of the words' lengths, answers that repeat the prompt's last word."""

    def encode(self, texts):
        return [[1.0] + [float(sum(len(w) % 7 == k for w in t.split())) for k in range(7)] for t in texts]

    def generate(self, prompts):
        return [f"{len(p)} characters" for p in prompts]

    def tokenize(self, texts):
        return [[len(w) for w in t.split()] for t in texts]

    def parameters(self):
        return [(3_000_000, False), (1_000_000, True)]


def test_jobs_with_a_model(spark, corpus):
    c, model = str(corpus), f"{__name__}:Toy"
    main(["split", "--train", f"{c}/train.csv", "--out", f"{c}/split", "--document", f"{c}/split.json", "--write"], spark)
    doc = json.loads((corpus / "split.json").read_text())
    assert doc["dataset_version"] == {"train_csv_sha256": hashlib.sha256((corpus / "train.csv").read_bytes()).hexdigest(), "train_row_count": 200}
    assert sorted(doc["train_row_ids"] + doc["validation_row_ids"]) == list(range(200)) and doc["split_ratio"]["train"] == len(doc["train_row_ids"]) / 200
    assert sum(doc["stratification_summary"]["validation"][x] for x in ("short", "medium", "long")) == doc["row_counts"]["validation"]
    assert doc["length_bucket_edges"]["short_medium"] < doc["length_bucket_edges"]["medium_long"] and doc["near_duplicate_detection"]["no_component_on_both_sides"]
    said = main(["retrieve", "--train", f"{c}/train.csv", "--split", f"{c}/split.json", "--out", f"{c}/out", "--ledger", f"{c}/ledger", "--model", model], spark)
    assert "Sentence Embedding" in said and readers.read_csv(spark, f"{c}/ledger").where("model_name LIKE '%sentence%'").count() == 1
    (corpus / "ex/e1/checkpoint-50").mkdir(parents=True)
    (corpus / "ex/e1/checkpoint-100").mkdir()
    prepare = ["prepare", "--train", f"{c}/train.csv", "--split", f"{c}/split.json", "--out", f"{c}/ex", "--ledger", f"{c}/ledger2", "--mode", "full", "--experiment-id", "e1", "--resume", "--model", model, "--max-seq-len", "8"]
    said = main(prepare, spark)
    assert said["resume_from"].endswith("checkpoint-100") and (corpus / "ex/e1/checkpoint-50").exists()
    assert said["examples"] == doc["row_counts"]["train"] and said["evaluation_examples"] == doc["row_counts"]["validation"]
    assert said["fertility"]["total"]["n_rows"] == 100 and "is over" in said["warning"]
    samples = json.loads((corpus / "ex/e1/smoke_samples.json").read_text())
    assert len(samples) == 5 and all(set(s) == {"patient_prompt", "reference_response", "generated_response"} and s["generated_response"].endswith("characters") for s in samples)
    rows = {r.experiment_id: r for r in readers.read_csv(spark, f"{c}/ledger2").collect()}
    assert set(rows) == {"e1", "e1-COMPLETE"} and rows["e1"].decision_next_step == "preparation started" and "finished in" in rows["e1-COMPLETE"].decision_next_step
    assert rows["e1"].exact_total_parameters == "0.004B" and rows["e1"].trainable_parameters == "1.0M" and rows["e1"].dataset_version.startswith("train_rows=200;sha256=")
    assert f"max_seq_len=8;batch=4x4;max_steps=-1;epochs=3;train_rows={doc['row_counts']['train']}" in rows["e1"].training_config
    (corpus / "ex/e1/smoke_samples.json").unlink()
    said = main([*prepare, "--skip-samples", "--experiment-id", "e2"], spark)
    assert said["resume_from"] is None and not (corpus / "ex/e2/smoke_samples.json").exists()


def test_audit_records_roles_and_sources(spark, corpus):
    c = str(corpus)
    (corpus / "config.yaml").write_text("id_column: id\nother: kept\n")
    main(["audit", "--train", f"{c}/train.csv", "--test", f"{c}/test.csv", "--out", f"{c}/out", "--config", f"{c}/config.yaml", "--sample-submission", f"{c}/none.csv"], spark)
    report, text = json.loads((corpus / "out/data_audit.json").read_text()), (corpus / "out/data_audit.md").read_text()
    assert report["config_update"] == readers.read_config(f"{c}/config.yaml") and report["config_update"]["prompt_column"] == "input" and report["config_update"]["other"] == "kept"
    assert report["source_files"] == {"train_filename": "train.csv", "test_filename": "test.csv"}
    assert report["notes"] == {"train_object_columns": ["input", "output"], "test_object_columns": ["input"], "sample_submission_present": False}
    assert all(f"## {x}" in text for x in ("Source files", "Notes")) and "- assessment: " in text and "- purpose: " in text
    assert (corpus / "out/data_audit_status.txt").read_text() == "finished\n"


def test_model_names():
    with pytest.raises(ValueError, match="module:factory"):
        readers.NamedModel("os.system('x')")


def test_report_renders(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "c")], "id long, question string, answer string")
    assert "- train rows: `2`" in render_markdown(audit_report(df, df.limit(0), "id"))
