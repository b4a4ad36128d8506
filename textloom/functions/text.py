"""Scalar text functions as Column expressions: all run inside the JVM, none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.constants import SYSTEM_PROMPT

#: Unicode white space, listed: Java's own class leaves four separators out, and is slow when it is asked for Unicode.
SPACES = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BANGLA, LATIN, DIGIT = r"[\x{0980}-\x{09FF}]", r"[A-Za-z]", r"[0-9]"
SCRIPT_TOKEN = r"[\x{0980}-\x{09FF}]+|[A-Za-z]+|\p{Nd}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """As text, null as empty."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def normalized(c: Column | str) -> Column:
    """White space runs as one space, none at the ends, lower case; null as empty."""
    return F.lower(F.trim(F.regexp_replace(filled(c), SPACES, " ")))


def tokens(c: Column | str) -> Column:
    """Words of the normalized text; of an empty one none."""
    return F.filter(F.split(normalized(c), " "), lambda t: t != "")


def n_chars(c: Column | str) -> Column:
    """Code points."""
    return F.length(filled(c)).cast("long")


def n_words(c: Column | str) -> Column:
    """Words between Unicode white space."""
    text = F.trim(F.regexp_replace(filled(c), SPACES, " "))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("long")


def class_count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(filled(c), F.lit(pattern)).cast("long")


def class_ratio(c: Column | str, pattern: str) -> Column:
    """Share of the characters that match; 0 for an empty text."""
    return F.coalesce(F.try_divide(class_count(c, pattern), n_chars(c)), F.lit(0.0))


def script_tokens(c: Column | str) -> Column:
    """Runs of Bangla letters, of Latin letters and of digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(filled(c)), F.lit(SCRIPT_TOKEN), F.lit(0))


def contains_ignoring_case(c: Column | str, part: Column | str) -> Column:
    return F.contains(F.lower(filled(c)), F.lower(part if isinstance(part, Column) else F.lit(part)))


def slug(c: Column | str, hyphens: bool = True) -> Column:
    """Lower case with underscores for spaces, and for hyphens too unless told not to."""
    return F.translate(F.lower(_col(c)), " -" if hyphens else " ", "__" if hyphens else "_")


def prefix(c: Column | str, length: int) -> Column:
    return F.substring(filled(c), 1, length)


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def run_id(mode: str) -> Column:
    """``<mode>-<UTC time>``."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.lit(f"{mode}-"), F.date_format(now, "yyyyMMdd'T'HHmmss"))


def key_values(pairs: Sequence[tuple[str, Column | str, str]]) -> Column:
    """``key=value;key=value``, each value in its printf format."""
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.format_string(fmt, _col(c))) for k, c, fmt in pairs))


def chat_messages(prompt: Column | str, response: Column | str | None = None, system: str = SYSTEM_PROMPT) -> Column:
    """``array<struct<role, content>>``: system, user and, if given, assistant."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = [message("system", F.lit(system)), message("user", filled(prompt))]
    return F.array(*parts, *([message("assistant", filled(response))] if response is not None else []))


def chat_text(messages: Column | str, generation_prompt: bool = False) -> Column:
    """The messages in the common im_start / im_end template, open for an answer if asked. The exact template belongs to
    a model's tokenizer, so this is the default of a parameter, not of the plan."""
    part = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    text = F.array_join(F.transform(_col(messages), part), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation_prompt else text


def truncated(ids: Column | str, length: int) -> Column:
    return F.slice(_col(ids), 1, length)


def padded(ids: Column | str, multiple: int = 8, fill: int = 0) -> Column:
    """Filled up to a multiple of a length."""
    short = F.pmod(-F.size(_col(ids)), F.lit(multiple))
    return F.concat(_col(ids), F.array_repeat(F.lit(fill), short))


def char_grams(c: Column | str, low: int = 3, high: int = 5) -> Column:
    """Grams of the padded words of the normalized text; a padded word not longer than a size is one gram, and its last."""
    word = lambda w: F.concat(F.lit(" "), w, F.lit(" "))

    def grams(w: Column) -> Column:
        p = word(w)
        size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - n + 1)), lambda i: F.substring(p, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), F.length(p)))), size))

    return F.flatten(F.transform(tokens(c), grams))
