"""The registered queries of the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.chat import chat_digests, fold_events, format_chats, turns_as_events
from textloom.llm.decontaminate import contaminated
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.pieces import encoding_digests
from textloom.llm.quality_classifier import classify_quality
from textloom.llm.quality_rules import quality_rules
from textloom.llm.simhash import simhash_components
from textloom.llm.suffix_dedup import dedup_substrings, digest
from textloom.llm.token_counts import count_tokens
from textloom.llm.url_rules import filter_urls
from textloom.plans.storage import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), stats_col="stats")
    return out.select("doc_id", "stats.n_lines", "stats.n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    probe = spark.sql("SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role FROM range(2)").withColumn("text", F.lit(hard))
    return chat_digests(format_chats(turns_as_events(turns.unionByName(probe))))


def chat_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a log of streamed deltas, edits and regenerations, folded back to the final messages.

    Every turn is drafted, regenerated and streamed again in three deltas; every third one gets a wrong text that an edit
    replaces, with a delta behind the edit; behind the last turn comes one that a regeneration takes away.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda at, kind, text, message="turn": f"struct({message} * 10 + {at} AS seq, '{kind}' AS event, {message} AS message, role, {text} AS text)"
    third = "cast(ceil(length(text) / 3) AS int)"
    streamed = [event(2, "delta", f"substring(text, 1, {third})"), event(3, "delta", f"substring(text, {third} + 1, {third})"), event(4, "delta", f"substring(text, 2 * {third} + 1)")]
    edited = [event(2, "message", "'wrong'"), event(3, "edit", f"substring(text, 1, {third})"), event(4, "delta", f"substring(text, {third} + 1)")]
    draft = [event(0, "delta", "'a draft'"), event(1, "regenerate", "NULL")]
    gone = [event(5, "message", "'never sent'", "turn + 1"), event(6, "regenerate", "NULL", "turn + 1")]
    last = "turn = max(turn) OVER (PARTITION BY conv_id)"
    log = turns.selectExpr("conv_id", f"concat(array({', '.join(draft)}), if(turn % 3 = 0, array({', '.join(edited)}), array({', '.join(streamed)})), if({last}, array({', '.join(gone)}), array())) AS events")
    messages = fold_events(log.select("conv_id", F.explode("events").alias("e")).select("conv_id", "e.*"))
    return messages.select("conv_id", "message", "role", F.sha2("text", 256).alias("text_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup_substrings(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_rules": op6_url_rules,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
}

#: Queries beside the ten.
FURTHER: dict[str, Callable[[SparkSession, str], DataFrame]] = {"chat_event_log": chat_event_log}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, parts[i] AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(i)
        ), windows AS (
            SELECT *, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3
            FROM lines WHERE regexp_matches(line, '[^ \t-\r]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), later AS (
            SELECT * FROM windows WHERE l3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1
        ), gone AS (
            SELECT doc_id, i FROM later UNION SELECT doc_id, i2 FROM later UNION SELECT doc_id, i3 FROM later
        )
        SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
    """,
    "op6_url_rules": r"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), r(v, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        SELECT page_id, host, path, h || q AS rule, coalesce(v, 'allow') AS verdict
        FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) = 1
    """,
    "chat_event_log": "SELECT conv_id, turn AS message, role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations",
    "op7_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
}
