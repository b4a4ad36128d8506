"""Results depend on them being exactly these."""

#: Risk-surface keywords, matched as case-insensitive substrings.
RISK_KEYWORDS = [
    "জরুরি", "emergency", "রক্তপাত", "bleeding", "বুক ব্যথা", "chest pain", "শ্বাসকষ্ট", "difficulty breathing", "অজ্ঞান", "faint",
    "স্ট্রোক", "stroke", "heart attack", "হার্ট অ্যাটাক", "convulsion", "খিঁচুনি", "suicid", "আত্মহত্যা", "poison", "বিষ",
    "pregnant", "pregnancy", "গর্ভবতী", "জ্বর", "pain", "ব্যথা",
]

#: Names that give away a prompt, response or category column.
PROMPT_NAMES = ["prompt", "question", "query", "input", "symptom", "patient"]
RESPONSE_NAMES = ["response", "answer", "reply", "output", "doctor"]
CATEGORY_NAMES = ["category", "specialty", "department", "field"]

#: Given for a prompt that exact matching does not find.
FALLBACK_TEXT = "ধন্যবাদ। সঠিক পরামর্শের জন্য একজন বিশেষজ্ঞ ডাক্তারের সাথে কথা বলুন।"

SYSTEM_PROMPT = "আপনি একজন অভিজ্ঞ বাংলাদেশি চিকিৎসক। রোগীর প্রশ্নের উত্তর বাংলায় সংক্ষিপ্ত ও স্পষ্টভাবে দিন।"

#: Texts that a CSV reader takes for null.
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SEED = 42
VALIDATION_RATIO = 0.10
NEAR_DUPLICATE_THRESHOLD = 0.90
VOCABULARY_TERMS = 25_000
BM25_K1, BM25_B = 1.5, 0.75
MAX_SEQUENCE = 512
PARAMETER_CAP = 3_000_000_000

#: Columns of the experiment ledger, in order.
LEDGER_COLUMNS = [
    "experiment_id", "git_commit", "dataset_version", "split_version", "model_name", "model_revision", "exact_total_parameters",
    "trainable_parameters", "tokenizer", "training_config", "generation_settings", "validation_metrics", "manual_safety_findings",
    "kaggle_notebook_version", "decision_next_step",
]

#: What a training of adapters is recorded with.
ADAPTER = {"r": 16, "alpha": 32, "dropout": 0.05, "targets": ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"]}

#: Training budgets by mode.
MODES = {
    "smoke": {"train_frac": 0.05, "num_train_epochs": 1, "max_steps": 100, "save_steps": 50, "logging_steps": 10, "per_device_train_batch_size": 4, "gradient_accumulation_steps": 4},
    "short": {"train_frac": 1.0, "num_train_epochs": 1, "max_steps": -1, "save_steps": 500, "logging_steps": 50, "per_device_train_batch_size": 4, "gradient_accumulation_steps": 4},
    "full": {"train_frac": 1.0, "num_train_epochs": 3, "max_steps": -1, "save_steps": 1000, "logging_steps": 100, "per_device_train_batch_size": 4, "gradient_accumulation_steps": 4},
}
