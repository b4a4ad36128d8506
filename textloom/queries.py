"""The engine's registered queries over the driver's tables, each with the SQL that says what it must return.

Roles: ``documents`` are prompts (``source`` the response); those whose id divides by ten are the test side. The user and
assistant turns of ``conversations`` are prompt/response pairs; those of every tenth conversation are queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions import text as X
from textloom.functions.constants import FALLBACK_TEXT, LEDGER_COLUMNS
from textloom.operators import duplicates as D
from textloom.operators import metrics as M
from textloom.operators import near_duplicates as N
from textloom.operators import profile as P
from textloom.operators import retrieval as R
from textloom.operators import split as S
from textloom.operators import training as T
from textloom.plans.audit import audit_summary as summary
from textloom.plans.storage import materialize, read_table, temporary
from textloom.sources.readers import latest_checkpoint, with_position
from textloom.sources.writers import ledger_rows, split_ledger_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYWORDS = ["THE", "license", "token", "und", "ción", "@mail", "pain"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir).select("doc_id", "text", "source")
    return d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chat_pairs(table(spark, sf_dir, "conversations"))


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = materialize(pairs(spark, sf_dir))  # read several times
    tenth = F.floor(F.col("id") / 1_000_000) % 10 == 0
    return p.where(tenth), p.where(~tenth)


# --- profiles


@query
def row_statistics(spark, sf_dir):
    return P.row_statistics(docs(spark, sf_dir), "text")


@query
def text_quality(spark, sf_dir):
    # read as it lies: means of fractions depend on the order of addition in their last digits
    return P.text_quality(table(spark, sf_dir, "documents"), "text")


@query
def missing_values(spark, sf_dir):
    both = docs(spark, sf_dir).select("doc_id", "text", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.missing_values(both, ["doc_id", "text", "lang", "quality", "toxic"])


@query
def schema_report(spark, sf_dir):
    return P.schema_report(docs(spark, sf_dir))


@query
def schema_roles(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return P.schema_roles(p)


@query
def normalized_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.sha256(X.normalized("text")).alias("normalized_sha256"), X.n_chars("text").alias("n_chars_counted"), X.n_words("text").alias("n_words"))


@query
def top_tokens(spark, sf_dir):
    return P.top_tokens(docs(spark, sf_dir), "text", "doc_id", 50)


@query
def vocabulary_size(spark, sf_dir):
    return P.vocabulary_size(docs(spark, sf_dir), "text")


@query
def keyword_hits(spark, sf_dir):
    return P.keyword_hits(docs(spark, sf_dir), "text", KEYWORDS)


@query
def repeated_responses(spark, sf_dir):
    return P.repeated_values(docs(spark, sf_dir), "source", 25)


@query
def response_diversity(spark, sf_dir):
    return P.value_diversity(docs(spark, sf_dir), "text")


# --- duplicates, conflicts, overlaps


@query
def duplicate_counts(spark, sf_dir):
    return D.duplicate_counts(docs(spark, sf_dir), "text", ["text", "lang", "source", "n_chars"])


@query
def duplicate_groups(spark, sf_dir):
    return D.prompt_groups(docs(spark, sf_dir), "text", "source", "doc_id", normalize=True).select(X.sha256("prompt").alias("prompt_sha256"), "n_rows", "n_responses", F.array_join("row_ids", ",").alias("row_ids"))


@query
def conflicting_groups(spark, sf_dir):
    return D.conflicting_groups(docs(spark, sf_dir), "text", "source", "doc_id").select(X.sha256("prompt").alias("prompt_sha256"), "n_rows", "n_responses", F.array_join("row_ids", ",").alias("row_ids"))


@query
def unique_prompt_rows(spark, sf_dir):
    return D.keep_first(docs(spark, sf_dir).select("doc_id", "text", "lang"), "text", "doc_id").select("doc_id", "lang")


@query
def cross_split_overlap(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return D.overlap_rows(test, train, "text").select("doc_id")


@query
def cross_split_pairs(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return D.overlap_pairs(test, train, "text", "doc_id").select("test_id", F.array_join("train_ids", ",").alias("train_ids"))


@query
def audit_summary(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return summary(train, test, "text", "source", "doc_id")


# --- near duplicates


@query
def length_bins(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.lit("documents").alias("side"), F.col("doc_id").alias("id"), F.length(X.normalized("text")).alias("length"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("side"), F.col("item_id").alias("id"), F.length(X.normalized("text")).alias("length"))
    both = d.unionByName(b)
    return N.binned(both, N.length_range(both)).select("side", "id", "length", "bucket")


@query
def bucket_candidates(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length(X.normalized("text")).alias("length"))
    return N.nearest_to_centre(N.binned(d, N.length_range(d)), "id", 20).select("id", "length", "bucket")


@query
def near_duplicates(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return N.near_duplicates(test, train, "text", "doc_id")


@query
def near_duplicates_capped(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return N.near_duplicates(test, train, "text", "doc_id", reference_mode=True)


@query
def components_exact(spark, sf_dir):
    return D.exact_components(docs(spark, sf_dir), "text", "doc_id")


@query
def components_near(spark, sf_dir):
    return N.near_components(docs(spark, sf_dir), "text", "doc_id")


# --- splits and samples


@query
def length_tertiles(spark, sf_dir):
    return S.length_tertiles(docs(spark, sf_dir), "text", "doc_id")


@query
def split_assign(spark, sf_dir):
    return S.split_assign(docs(spark, sf_dir), "text", "doc_id")


@query
def split_summary(spark, sf_dir):
    return S.split_summary(split_assign(spark, sf_dir))


@query
def leakage_check(spark, sf_dir):
    return S.leakage_check(split_assign(spark, sf_dir))


@query
def fallback_split(spark, sf_dir):
    return S.fallback_split(docs(spark, sf_dir), "doc_id")


@query
def train_subset(spark, sf_dir):
    return T.training_rows(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "smoke")


@query
def review_sample(spark, sf_dir):
    return S.fixed_sample(docs(spark, sf_dir), "doc_id", 5).select("doc_id", X.prefix("text", 200).alias("shown"))


@query
def linspace_sample(spark, sf_dir):
    return S.evenly_spaced(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", 77)


@query
def row_positions(spark, sf_dir):
    return with_position(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


# --- retrieval and its scores


@query
def chat_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query
def exact_match_retrieval(spark, sf_dir):
    test, train = sides(spark, sf_dir)
    return R.exact_match(test, train, "text", "source", "doc_id")


@query
def tfidf_top1(spark, sf_dir):
    q, c = asked(spark, sf_dir)
    return R.tfidf_top1(q, c, "prompt", "response", "id").select("query_id", "doc_id", "score", "matched")


@query
def bm25_top1(spark, sf_dir):
    q, c = asked(spark, sf_dir)
    return R.bm25_top1(q, c, "prompt", "response", "id").select("query_id", "doc_id", "score", "matched")


@query
def dense_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.dense_top1(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "vec_id", "embedding")


def _answered(q: DataFrame, c: DataFrame, method: str) -> DataFrame:
    if method == "exact":
        found = R.exact_match(q, c, "prompt", "response", "id")
    else:
        found = {"tfidf": R.tfidf_top1, "bm25": R.bm25_top1}[method](q, c, "prompt", "response", "id").select("query_id", "prediction", F.lit(False).alias("is_fallback"))
    return found.join(q.select(F.col("id").alias("query_id"), F.col("response").alias("target")), "query_id")


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each pair's response against the response of the pair before it: texts to score without a retriever."""
    from pyspark.sql.window import Window as W

    p = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return p.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), F.coalesce(before, F.lit("")).alias("prediction"), F.col("text").alias("target"))


@query
def token_f1(spark, sf_dir):
    s = M.token_scores(_neighbours(spark, sf_dir))
    return s.select("query_id", *(F.round(c, 9).alias(c) for c in s.columns[1:]))


@query
def rouge_l(spark, sf_dir):
    s = M.rouge_scores(_neighbours(spark, sf_dir))
    return s.select("query_id", *(F.round(c, 9).alias(c) for c in s.columns[1:]))


@query
def response_reuse(spark, sf_dir):
    return M.reuse_rate(docs(spark, sf_dir), "source")


@query
def answer_lengths(spark, sf_dir):
    """Lengths, fallbacks and reuse of what exact matching answers: the parts of a record that need no text kernel."""
    test, train = sides(spark, sf_dir)
    found = R.exact_match(test, train, "text", "source", "doc_id").join(test.select(F.col("doc_id").alias("query_id"), F.col("source").alias("target")), "query_id")
    record = M.evaluate(found, "Exact Match")
    return record.select("method_name", "fallback_rate", "unique_responses_retrieved", "top_10_response_reuse_rate", "retrieved_length_mean_chars", "retrieved_length_median_chars", "actual_length_mean_chars", "actual_length_median_chars", "length_mismatch_flag")


@query
def retrieval_eval(spark, sf_dir):
    out = None
    with temporary() as kept:  # the answers; what led to them is gone before they are scored
        q, c = asked(spark, sf_dir)
        for method in ("exact", "tfidf", "bm25"):
            kept.append(materialize(_answered(q, c, method)))
    for answered, name in zip(kept, ("Exact Match", "TF-IDF", "BM25"), strict=True):
        one = M.evaluate(answered, name, distinct=M.distinct_keys(answered, "query_id"))
        out = one if out is None else out.unionByName(one)
    # means are rounded: their last digits depend on the order of addition
    return out.select(*(F.round(f.name, 9).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name for f in out.schema.fields))


# --- training sets and ledger


@query
def chat_format(spark, sf_dir):
    f = T.formatted(pairs(spark, sf_dir), "prompt", "response", "id")
    return f.select("id", F.length("text").cast("long").alias("n_chars"), X.sha256("text").alias("text_sha256"))


@query
def token_length_stats(spark, sf_dir):
    p = pairs(spark, sf_dir).select((X.n_words("prompt") + X.n_words("response")).alias("n_tokens"))
    return P.length_report(p, "n_tokens", 100)


@query
def tokenized_examples(spark, sf_dir):
    t = T.tokenized(T.formatted(pairs(spark, sf_dir), "prompt", "response", "id"), "text", "id")
    return t.select("id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"))


@query
def latest_checkpoint_step(spark, sf_dir):
    names = spark.createDataFrame([(f"models/run/checkpoint-{n}",) for n in (50, 100, 9)] + [("models/run/final",)], "path string")
    return latest_checkpoint(names)


@query
def split_ledger(spark, sf_dir):
    return split_ledger_row(split_assign(spark, sf_dir))


@query
def retrieval_ledger(spark, sf_dir):
    return ledger_rows(retrieval_eval(spark, sf_dir), "split_v1")


# --- the SQL

NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+', ' ', 'g')))"
T_NORM = NORM.format("text")
WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
SCRIPT = r"regexp_extract_all(lower(coalesce(text, '')), '[\x{0980}-\x{09FF}]+|[A-Za-z]+|\p{Nd}+')"
FIVE = "min({0})::BIGINT AS {1}_min, max({0})::BIGINT AS {1}_max, avg({0}) AS {1}_mean, quantile_cont({0}, 0.5)::DOUBLE AS {1}_median, quantile_cont({0}, 0.95)::DOUBLE AS {1}_p95"
PAIRS = """pairs AS (
    SELECT conv_id * 1000000 + turn AS id, text AS prompt, next_text AS response
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x
    WHERE role = 'user' AND next_role = 'assistant'
)"""
ASKED = PAIRS + f""", q AS (SELECT id, {NORM.format('prompt')} AS t FROM pairs WHERE (id // 1000000) % 10 = 0), c AS (SELECT id, {NORM.format('prompt')} AS t FROM pairs WHERE (id // 1000000) % 10 <> 0),
qt AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest({WORDS.format('t')}) AS w FROM q) x GROUP BY ALL),
ct AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest({WORDS.format('t')}) AS w FROM c) x GROUP BY ALL)"""
BEST = """best AS (SELECT * FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1)
SELECT q.id AS query_id, coalesce(doc_id, (SELECT min(id) FROM c)) AS doc_id, coalesce(score, 0.0) AS score, doc_id IS NOT NULL AS matched FROM q LEFT JOIN best ON query_id = q.id"""
COMPONENTS = f"comp AS (SELECT doc_id AS id, text, min(doc_id) OVER (PARTITION BY {T_NORM}) AS component FROM documents)"
EDGES = f"edges AS (SELECT quantile_cont(length({T_NORM}), 1/3::DOUBLE) AS e1, quantile_cont(length({T_NORM}), 2/3::DOUBLE) AS e2 FROM documents)"
LABEL = f"CASE WHEN length({T_NORM}) <= e1 THEN 'short' WHEN length({T_NORM}) <= e2 THEN 'medium' ELSE 'long' END"
SPLIT = f"""{COMPONENTS}, {EDGES},
lab AS (SELECT id, component, {LABEL} AS label FROM comp, edges),
ctab AS (SELECT component, label FROM (SELECT component, label, count(*) AS n FROM lab GROUP BY ALL) x QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, label) = 1),
tot AS (SELECT count(*) AS a, ceil(0.1::DOUBLE * count(*))::BIGINT AS target FROM ctab),
quo AS (SELECT label, n * target // a AS share, n * target % a AS rest, target FROM (SELECT label, count(*) AS n FROM ctab GROUP BY label) x, tot),
quota AS (SELECT label, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= target - sum(share) OVER () THEN 1 ELSE 0 END AS quota FROM quo),
sided AS (SELECT component, c.label, CASE WHEN row_number() OVER (PARTITION BY c.label ORDER BY md5(component::VARCHAR || '-42'), component) <= quota THEN 'validation' ELSE 'train' END AS side FROM ctab c JOIN quota USING (label)),
assigned AS (SELECT id, component, s.label, side FROM lab JOIN sided s USING (component))"""
GRAM_VECTORS = f"""words AS (SELECT id, side, ' ' || unnest({WORDS.format('t')}) || ' ' AS p FROM texts),
sizes AS (SELECT id, side, p, unnest(range(3, least(5, greatest(3, length(p))) + 1)) AS n FROM words),
grams AS (SELECT id, side, n, p, unnest(range(1, greatest(1, length(p) - n + 1) + 1)) AS i FROM sizes),
counts AS (SELECT id, side, substr(p, i, n) AS gram, count(*) AS c FROM grams GROUP BY ALL),
vec AS (SELECT id, side, gram, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM counts)"""
GRAMS = GRAM_VECTORS + """,
scored AS (SELECT l.id AS test_id, r.id AS train_id, round(sum(l.w * r.w), 6) AS score FROM vec l JOIN vec r USING (gram) WHERE l.side = 0 AND r.side = 1 GROUP BY ALL)"""
#: Of a table p (id, a, b): the words of both, their multiset overlap, and the longest common subsequence by rows.
OVERLAPS = f"""aw AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT id, {WORDS.format(NORM.format('a'))} AS l FROM p) x),
bw AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS j FROM (SELECT id, {WORDS.format(NORM.format('b'))} AS l FROM p) x),
steps(id, i, j, v) AS (
    SELECT id, 0::BIGINT, j, 0::BIGINT FROM bw
    UNION ALL
    SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (
        SELECT s.id, aw.i, s.j, CASE WHEN aw.w = bw.w THEN 1 + coalesce(lag(s.v) OVER (PARTITION BY s.id ORDER BY s.j), 0) ELSE s.v END AS c
        FROM steps s JOIN aw ON aw.id = s.id AND aw.i = s.i + 1 JOIN bw ON bw.id = s.id AND bw.j = s.j
    ) x
),
sizes AS (SELECT p.id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(l, 0)::DOUBLE AS l, coalesce(o, 0)::DOUBLE AS o FROM p
    LEFT JOIN (SELECT id, count(*) AS x FROM aw GROUP BY id) USING (id) LEFT JOIN (SELECT id, count(*) AS y FROM bw GROUP BY id) USING (id) LEFT JOIN (SELECT id, max(v) AS l FROM steps GROUP BY id) USING (id)
    LEFT JOIN (SELECT id, sum(least(n, m)) AS o FROM (SELECT id, w, count(*) AS n FROM aw GROUP BY ALL) q JOIN (SELECT id, w, count(*) AS m FROM bw GROUP BY ALL) r USING (id, w) GROUP BY id) USING (id)),
shares AS (SELECT id, CASE WHEN x + y = 0 THEN 1.0::DOUBLE WHEN x = 0 THEN 0 ELSE l / x END AS lp, CASE WHEN x + y = 0 THEN 1.0::DOUBLE WHEN y = 0 THEN 0 ELSE l / y END AS lr,
    CASE WHEN x + y = 0 THEN 1.0::DOUBLE WHEN x = 0 THEN 0 ELSE o / x END AS tp, CASE WHEN x + y = 0 THEN 1.0::DOUBLE WHEN y = 0 THEN 0 ELSE o / y END AS tr FROM sizes),
scored AS (SELECT id, lp, lr, CASE WHEN lp + lr = 0 THEN 0 ELSE 2 * lp * lr / (lp + lr) END AS lf, tp, tr, CASE WHEN tp + tr = 0 THEN 0 ELSE 2 * tp * tr / (tp + tr) END AS tf FROM shares)"""
#: A pair in the chat template.
FORMATTED = "'<|im_start|>system' || chr(10) || 'আপনি একজন অভিজ্ঞ বাংলাদেশি চিকিৎসক। রোগীর প্রশ্নের উত্তর বাংলায় সংক্ষিপ্ত ও স্পষ্টভাবে দিন।' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10)"
BUCKET = "CASE WHEN low = high THEN 0 ELSE least(4, greatest(0, ceil((len - low) / ((high + 1 - low) / 5.0::DOUBLE)) - 1)) END::INTEGER"
CENTRE = "CASE WHEN low = high THEN low::DOUBLE ELSE low + (bucket + 0.5::DOUBLE) * ((high + 1 - low) / 5.0::DOUBLE) END"
GROUPS = "SELECT sha256({0}) AS prompt_sha256, count(*) AS n_rows, count(DISTINCT coalesce(source, '')) AS n_responses, array_to_string(list_sort(list(doc_id))[1:10], ',') AS row_ids FROM documents WHERE {0} <> '' GROUP BY {0} HAVING count(*) > 1"

ORACLE_SQL |= {
    "row_statistics": f"SELECT count(*) AS n_rows, count(*) - count(text) AS n_missing, count(DISTINCT coalesce(text, '')) AS n_unique, {FIVE.format('c', 'chars')}, {FIVE.format('w', 'words')} FROM (SELECT text, length(coalesce(text, '')) AS c, len({WORDS.format(T_NORM)}) AS w FROM documents) x",
    "text_quality": r"""SELECT avg(b / n) AS mean_bangla_ratio, avg(l / n) AS mean_latin_ratio, avg(d / n) AS mean_digit_ratio, count(*) FILTER (WHERE b > 0) AS rows_with_bangla, count(*) FILTER (WHERE b = 0) AS rows_without_bangla, count(*) AS utf8_rows, 0::BIGINT AS non_utf8_rows
        FROM (SELECT len(regexp_extract_all(text, '[\x{0980}-\x{09FF}]'))::DOUBLE AS b, len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE AS l, len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS d, length(text) AS n FROM documents) x""",
    "missing_values": "WITH j AS (SELECT d.doc_id, text, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM j" for c in ("doc_id", "text", "lang", "quality", "toxic")),
    "schema_report": "SELECT p::BIGINT AS position, c AS column_name, t AS data_type, (SELECT count(*) FROM documents) AS n_rows FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v(p, c, t)",
    "schema_roles": "SELECT * FROM (VALUES ('prompt', 'prompt'), ('response', 'response')) v(role, column_name)",
    "normalized_text": f"SELECT doc_id, sha256({T_NORM}) AS normalized_sha256, length(coalesce(text, '')) AS n_chars_counted, len({WORDS.format(T_NORM)}) AS n_words FROM documents",
    "top_tokens": f"SELECT token, count(*) AS n FROM (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, {SCRIPT} AS l FROM documents) y) x GROUP BY token ORDER BY n DESC, min((doc_id, p)) LIMIT 50",
    "vocabulary_size": f"SELECT count(DISTINCT token) AS n_tokens, least(count(DISTINCT token), 10000)::BIGINT AS n_tokens_capped FROM (SELECT unnest({SCRIPT}) AS token FROM documents) x",
    "keyword_hits": "SELECT k AS keyword, count(*) AS n FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents) d JOIN (VALUES " + ", ".join(f"('{k}')" for k in KEYWORDS) + ") v(k) ON contains(lower(t), lower(k)) GROUP BY k",
    "repeated_responses": "SELECT coalesce(source, '') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 25",
    "response_diversity": "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, count(*) / sum(n)::DOUBLE AS unique_ratio, count(*) FILTER (WHERE n >= 2) AS seen_twice, count(*) FILTER (WHERE n >= 5) AS seen_five_times FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, '')) x",
    "duplicate_counts": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents) x) AS full_row_duplicates, count(*) - count(DISTINCT coalesce(text, '')) AS prompt_duplicates FROM documents",
    "duplicate_groups": GROUPS.format(T_NORM),
    "conflicting_groups": GROUPS.format("text") + " AND count(DISTINCT coalesce(source, '')) > 1",
    "audit_summary": """WITH tr AS (SELECT doc_id, text, source FROM documents WHERE doc_id % 10 <> 0), te AS (SELECT doc_id, text, source FROM documents WHERE doc_id % 10 = 0),
        g AS (SELECT count(DISTINCT coalesce(source, '')) AS r FROM tr WHERE text <> '' GROUP BY text HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM te) AS test_rows,
        (SELECT count(*) FROM tr) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tr) x) AS train_full_row_duplicates, (SELECT count(*) - count(DISTINCT coalesce(text, '')) FROM tr) AS train_prompt_duplicates,
        (SELECT count(*) FROM te) - (SELECT count(*) FROM (SELECT DISTINCT * FROM te) x) AS test_full_row_duplicates, (SELECT count(*) - count(DISTINCT coalesce(text, '')) FROM te) AS test_prompt_duplicates,
        (SELECT count(*) FROM te WHERE text IN (SELECT text FROM tr WHERE text <> '')) AS exact_overlap_rows, (SELECT count(*) FROM g) AS duplicate_prompt_groups, (SELECT count(*) FROM g WHERE r > 1) AS conflicting_prompt_groups""",
    "unique_prompt_rows": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1",
    "cross_split_overlap": "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND text <> '' AND text IN (SELECT text FROM documents WHERE doc_id % 10 <> 0)",
    "cross_split_pairs": "SELECT a.doc_id AS test_id, array_to_string(list_sort(list(b.doc_id))[1:10], ',') AS train_ids FROM documents a JOIN documents b USING (text) WHERE a.doc_id % 10 = 0 AND b.doc_id % 10 <> 0 AND text <> '' GROUP BY a.doc_id",
    "length_bins": f"WITH b AS (SELECT 'documents' AS side, doc_id AS id, length({T_NORM}) AS len FROM documents UNION ALL SELECT 'benchmark', item_id, length({T_NORM}) FROM benchmark), s AS (SELECT min(len) AS low, max(len) AS high FROM b) SELECT side, id, len AS length, {BUCKET} AS bucket FROM b, s",
    "bucket_candidates": f"WITH b AS (SELECT doc_id AS id, length({T_NORM}) AS len FROM documents), s AS (SELECT min(len) AS low, max(len) AS high FROM b), x AS (SELECT id, len, low, high, {BUCKET} AS bucket FROM b, s) SELECT id, len AS length, bucket FROM x QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY abs(len - {CENTRE}), id) <= 20",
    "near_duplicates": f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS side, {T_NORM} AS t FROM documents),
        texts AS (SELECT *, length(t) AS len FROM d WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY side, t ORDER BY id) = 1),
        {GRAMS}, s AS (SELECT min(len) AS low, max(len) AS high FROM texts), b AS (SELECT id, {BUCKET} AS bucket FROM texts, s)
        SELECT test_id, train_id, score FROM scored JOIN b l ON l.id = test_id JOIN b r ON r.id = train_id WHERE score >= 0.9 AND abs(l.bucket - r.bucket) <= 1
        QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY score DESC, train_id) = 1""",
    "near_duplicates_capped": f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS side, {T_NORM} AS t, coalesce(text, '') AS raw FROM documents),
        first AS (SELECT *, length(raw) AS len FROM d WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY side, raw ORDER BY id) = 1), s AS (SELECT min(len) AS low, max(len) AS high FROM first),
        b AS (SELECT *, {BUCKET} AS bucket FROM first, s),
        texts AS (SELECT * FROM b QUALIFY side = 0 OR row_number() OVER (PARTITION BY side, bucket ORDER BY abs(len - {CENTRE}), id) <= 1000), {GRAMS}
        SELECT test_id, train_id, score FROM scored JOIN b l ON l.id = test_id JOIN b r ON r.id = train_id WHERE score >= 0.9 AND l.bucket = r.bucket
        QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY score DESC, train_id) = 1""",
    "components_near": f"""WITH RECURSIVE texts AS (SELECT min(doc_id) AS id, 0 AS side, {T_NORM} AS t FROM documents GROUP BY {T_NORM}), {GRAM_VECTORS},
        links AS (SELECT l.id AS a, r.id AS b FROM vec l JOIN vec r ON l.gram = r.gram AND l.id < r.id GROUP BY ALL HAVING round(sum(l.w * r.w), 6) >= 0.9),
        linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(id, node) AS (SELECT id, id FROM texts UNION SELECT r.id, linked.b FROM reached r JOIN linked ON linked.a = r.node)
        SELECT doc_id AS id, component FROM documents JOIN texts ON t = {T_NORM} JOIN (SELECT id, min(node) AS component FROM reached GROUP BY id) x USING (id)""",
    "components_exact": f"WITH {COMPONENTS} SELECT id, component FROM comp",
    "length_tertiles": f"WITH {EDGES} SELECT doc_id AS id, length({T_NORM}) AS length, {LABEL} AS label FROM documents, edges",
    "split_assign": f"WITH {SPLIT} SELECT id, component, label, side FROM assigned",
    "split_summary": f"WITH {SPLIT} SELECT side, count(*) AS n_rows, count(*) FILTER (WHERE label = 'short') AS short, count(*) FILTER (WHERE label = 'medium') AS medium, count(*) FILTER (WHERE label = 'long') AS long, count(*) / sum(count(*)) OVER ()::DOUBLE AS ratio FROM assigned GROUP BY side",
    "leakage_check": f"WITH {SPLIT} SELECT count(*) AS n_components, count(*) FILTER (WHERE n > 1) AS n_leaking, count(*) FILTER (WHERE n > 1) = 0 AS no_leakage FROM (SELECT component, count(DISTINCT side) AS n FROM assigned GROUP BY component) x",
    "fallback_split": "SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) <= floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS side FROM documents",
    "train_subset": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) <= greatest(1, floor(0.05::DOUBLE * count(*) OVER ()))",
    "review_sample": "SELECT doc_id, substr(text, 1, 200) AS shown FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 5",
    "linspace_sample": "WITH n AS (SELECT count(*) AS n FROM documents), spots AS (SELECT CASE WHEN i = 76 THEN n - 1 ELSE floor(i * ((n - 1) / 76::DOUBLE)) END AS p FROM n, range(77) r(i)), pos AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) SELECT doc_id, lang FROM pos WHERE p IN (SELECT p FROM spots)",
    "row_positions": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS position FROM documents",
    "chat_pairs": f"WITH {PAIRS} SELECT id, prompt, response FROM pairs",
    "exact_match_retrieval": f"WITH c AS (SELECT {T_NORM} AS t, arg_min(source, doc_id) AS found FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1) SELECT doc_id AS query_id, coalesce(found, 'ধন্যবাদ। সঠিক পরামর্শের জন্য একজন বিশেষজ্ঞ ডাক্তারের সাথে কথা বলুন।') AS prediction, t IS NULL AS is_fallback FROM documents LEFT JOIN c ON t = {T_NORM} WHERE doc_id % 10 = 0",
    "tfidf_top1": f"""WITH {ASKED}, voc AS (SELECT term, count(*) AS df FROM ct GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 25000), n AS (SELECT count(*) AS n FROM c),
        raw AS (SELECT s, id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM (SELECT 0 AS s, * FROM qt UNION ALL SELECT 1, * FROM ct) x JOIN voc USING (term), n),
        vec AS (SELECT s, id, term, v / sqrt(sum(v * v) OVER (PARTITION BY s, id)) AS w FROM raw),
        scores AS (SELECT a.id AS query_id, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score FROM vec a JOIN vec b USING (term) WHERE a.s = 0 AND b.s = 1 GROUP BY ALL), {BEST}""",
    "bm25_top1": f"""WITH {ASKED}, dl AS (SELECT id, sum(tf) AS dl FROM ct GROUP BY id), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
        vec AS (SELECT id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM ct JOIN dl USING (id) JOIN df USING (term), st),
        scores AS (SELECT qt.id AS query_id, vec.id AS doc_id, round(sum(w), 6) AS score FROM qt JOIN vec USING (term) GROUP BY ALL), {BEST}""",
    "dense_top1": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1",
    "token_f1": f"""WITH p AS (SELECT conv_id * 1000000 + turn AS id, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a, text AS b FROM conversations WHERE role = 'assistant'),
        w AS (SELECT id, unnest({WORDS.format(NORM.format('a'))}) AS w, 1 AS x, 0 AS y FROM p UNION ALL SELECT id, unnest({WORDS.format(NORM.format('b'))}), 0, 1 FROM p),
        c AS (SELECT id, w, sum(x) AS x, sum(y) AS y FROM w GROUP BY ALL), o AS (SELECT id, sum(least(x, y))::DOUBLE AS o, sum(x) AS x, sum(y) AS y FROM c GROUP BY id),
        s AS (SELECT p.id, CASE WHEN coalesce(x, 0) = 0 AND coalesce(y, 0) = 0 THEN 1.0 WHEN coalesce(x, 0) = 0 THEN 0.0 ELSE o / x END AS pr, CASE WHEN coalesce(x, 0) = 0 AND coalesce(y, 0) = 0 THEN 1.0 WHEN coalesce(y, 0) = 0 THEN 0.0 ELSE o / y END AS re FROM p LEFT JOIN o ON o.id = p.id)
        SELECT id AS query_id, round(pr::DOUBLE, 9) AS token_precision, round(re::DOUBLE, 9) AS token_recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END::DOUBLE, 9) AS token_f1 FROM s""",
    "rouge_l": f"""WITH RECURSIVE p AS (SELECT conv_id * 1000000 + turn AS id, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a, text AS b FROM conversations WHERE role = 'assistant'), {OVERLAPS}
        SELECT id AS query_id, round(lp, 9) AS rouge_l_precision, round(lr, 9) AS rouge_l_recall, round(lf, 9) AS rouge_l_f1 FROM scored""",
    "response_reuse": "WITH f AS (SELECT count(*) AS c FROM documents GROUP BY source), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS i, count(*) OVER () AS k, sum(c) OVER () AS n FROM f) SELECT max(k) AS unique_responses_retrieved, sum(c) FILTER (WHERE i <= greatest(1, floor(0.1 * k))) / max(n)::DOUBLE AS top_10_response_reuse_rate FROM r",
    "answer_lengths": f"""WITH c AS (SELECT {T_NORM} AS t, arg_min(source, doc_id) AS found FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1),
        p AS (SELECT coalesce(found, 'ধন্যবাদ। সঠিক পরামর্শের জন্য একজন বিশেষজ্ঞ ডাক্তারের সাথে কথা বলুন।') AS prediction, t IS NULL AS miss, source AS target FROM documents LEFT JOIN c ON t = {T_NORM} WHERE doc_id % 10 = 0),
        f AS (SELECT count(*) AS c FROM p GROUP BY prediction), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS i, count(*) OVER () AS k, sum(c) OVER () AS n FROM f),
        l AS (SELECT avg(miss::INTEGER) AS fallback_rate, avg(length(prediction)) AS retrieved_length_mean_chars, quantile_cont(length(prediction), 0.5)::DOUBLE AS retrieved_length_median_chars, avg(length(target)) AS actual_length_mean_chars, quantile_cont(length(target), 0.5)::DOUBLE AS actual_length_median_chars FROM p)
        SELECT 'Exact Match' AS method_name, l.*, (SELECT max(k) FROM r) AS unique_responses_retrieved, (SELECT sum(c) FILTER (WHERE i <= greatest(1, floor(0.1 * k))) / max(n)::DOUBLE FROM r) AS top_10_response_reuse_rate,
        abs(retrieved_length_mean_chars - actual_length_mean_chars) / greatest(actual_length_mean_chars, 1.0) > 0.5 AS length_mismatch_flag FROM l""",
    "chat_format": f"WITH {PAIRS}, f AS (SELECT id, {FORMATTED} AS t FROM pairs) SELECT id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM f",
    "token_length_stats": f"""WITH {PAIRS}, n AS (SELECT len({WORDS.format(NORM.format('prompt'))}) + len({WORDS.format(NORM.format('response'))}) AS n FROM pairs)
        SELECT count(*) AS n_rows, avg(n) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.95)::DOUBLE AS p95_interpolated, max(n) AS max, list_sort(list(n))[floor(0.95::DOUBLE * count(*))::BIGINT + 1] AS p95, list_sort(list(n))[floor(0.95::DOUBLE * count(*))::BIGINT + 1] > 100 AS over_limit FROM n""",
    "tokenized_examples": f"""WITH {PAIRS}, f AS (SELECT id, {FORMATTED} AS t FROM pairs), t AS (SELECT id, list_transform({WORDS.format(NORM.format('t'))}[1:512], lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000) AS ids FROM f), p AS (SELECT id, ids, (8 - len(ids) % 8) % 8 AS k FROM t)
        SELECT id, len(ids) AS n_tokens, array_to_string(list_concat(ids, list_transform(range(k), lambda i: 0)), ',') AS input_ids, array_to_string(list_concat(ids, list_transform(range(k), lambda i: -100)), ',') AS labels FROM p""",
    "latest_checkpoint_step": "SELECT 'models/run/checkpoint-100' AS path, 100::BIGINT AS step",
    "split_ledger": f"WITH {SPLIT} SELECT 'split_v1_seed42' AS experiment_id, 'train_rows=' || count(*) FILTER (WHERE side = 'train') || ';validation_rows=' || count(*) FILTER (WHERE side = 'validation') AS dataset_version, 'split_v1' AS split_version, 'split_creation' AS model_name, 'approved fixed split for all future experiments' AS decision_next_step, " + ", ".join(f"'' AS {c}" for c in LEDGER_COLUMNS if c not in ("experiment_id", "dataset_version", "split_version", "model_name", "decision_next_step")) + " FROM assigned",
}

_ANSWERED = f"""RECURSIVE {PAIRS}, answers AS (
    SELECT 0 AS m, q.id AS query_id, coalesce(c.found, '{FALLBACK_TEXT}') AS prediction, c.t IS NULL AS miss FROM pairs q LEFT JOIN (SELECT {NORM.format('prompt')} AS t, arg_min(response, id) AS found FROM pairs WHERE (id // 1000000) % 10 <> 0 GROUP BY 1) c ON c.t = {NORM.format('q.prompt')} WHERE (q.id // 1000000) % 10 = 0
    UNION ALL SELECT 1, query_id, response, FALSE FROM ({ORACLE_SQL['tfidf_top1']}) f JOIN pairs ON id = doc_id
    UNION ALL SELECT 2, query_id, response, FALSE FROM ({ORACLE_SQL['bm25_top1']}) f JOIN pairs ON id = doc_id
), p AS (SELECT query_id * 3 + m AS id, m, answers.prediction AS a, pairs.response AS b, miss FROM answers JOIN pairs ON pairs.id = query_id), {OVERLAPS},
f AS (SELECT m, count(*) AS c FROM p GROUP BY m, a), r AS (SELECT m, c, row_number() OVER (PARTITION BY m ORDER BY c DESC) AS i, count(*) OVER (PARTITION BY m) AS k, sum(c) OVER (PARTITION BY m) AS n FROM f),
reuse AS (SELECT m, max(k) AS k, sum(c) FILTER (WHERE i <= greatest(1, floor(0.1 * k))) / max(n)::DOUBLE AS share FROM r GROUP BY m),
record AS (SELECT m, avg(tf) AS tf, avg(tp) AS tp, avg(tr) AS tr, avg(lf) AS lf, avg(lp) AS lp, avg(lr) AS lr, avg(miss::INTEGER) AS miss, avg(length(a)) AS am, quantile_cont(length(a), 0.5)::DOUBLE AS ad, avg(length(b)) AS bm, quantile_cont(length(b), 0.5)::DOUBLE AS bd
    FROM p JOIN scored USING (id) GROUP BY m),
records AS (SELECT ['Exact Match', 'TF-IDF', 'BM25'][m + 1] AS method_name, round(tf, 9) AS token_f1, round(tp, 9) AS token_precision, round(tr, 9) AS token_recall, round(lf, 9) AS rouge_l_f1, round(lp, 9) AS rouge_l_precision, round(lr, 9) AS rouge_l_recall,
    round(lf, 9) AS bert_score_f1, TRUE AS bert_score_is_proxy, NULL::DOUBLE AS total_time_seconds, NULL::DOUBLE AS ms_per_query, round(miss, 9) AS fallback_rate, k AS unique_responses_retrieved, round(share, 9) AS top_10_response_reuse_rate,
    round(am, 9) AS retrieved_length_mean_chars, ad AS retrieved_length_median_chars, round(bm, 9) AS actual_length_mean_chars, bd AS actual_length_median_chars, abs(am - bm) / greatest(bm, 1.0) > 0.5 AS length_mismatch_flag FROM record JOIN reuse USING (m))"""
_LEDGER = {
    "experiment_id": "'baseline_' || translate(lower(method_name), ' -', '__')",
    "dataset_version": "'split_version=split_v1'",
    "split_version": "'split_v1'",
    "model_name": "'retrieval_baseline_' || translate(lower(method_name), ' ', '_')",
    "model_revision": "'v1'",
    "exact_total_parameters": "'0'",
    "trainable_parameters": "'0'",
    "tokenizer": "'bengali_whitespace'",
    "training_config": "'retrieval_baseline_non_trainable'",
    "generation_settings": "'top1_nearest_neighbor'",
    "validation_metrics": "printf('token_f1=%.4f;rouge_l_f1=%.4f;bert_score_f1=%.4f;ms_per_query=%.2f;fallback_rate=%.4f', token_f1, rouge_l_f1, bert_score_f1, coalesce(ms_per_query, 0.0::DOUBLE), fallback_rate)",
    "manual_safety_findings": "'retrieval_from_train_corpus'",
    "decision_next_step": "'baseline score logged for model comparison'",
}
ORACLE_SQL |= {
    "retrieval_eval": f"WITH {_ANSWERED} SELECT * FROM records",
    "retrieval_ledger": f"WITH {_ANSWERED} SELECT " + ", ".join(_LEDGER.get(c, "''") + f" AS {c}" for c in LEDGER_COLUMNS) + " FROM records",
}
